"""Session helpers: the shared folder, cut lineage, table paths."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []  # folders of this process, to be removed at its end


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir of the session.

    Where the session names none, the checkpoint directory of its context is taken. Only a local master may have
    neither (tests, a laptop): a temporary folder is made and kept as the context's. On a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="twinline-checkpoint-")
        _made.append(named)
    context.setCheckpointDir(named)
    _made.append(context._jsc.sc().getCheckpointDir().get())
    return spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table below the shared folder. It is removed when the process ends."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _made.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Removes the checkpoints and written tables of this process. No DataFrame made before may be used any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _made:
        p = jvm.org.apache.hadoop.fs.Path(_made.pop())
        p.getFileSystem(conf).delete(p, True)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined() and not jvm.org.apache.hadoop.fs.Path(current.get()).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(current.get())):
        parent = os.path.dirname(current.get().rstrip("/"))
        spark.sparkContext.setCheckpointDir(parent)
        _made.append(spark.sparkContext._jsc.sc().getCheckpointDir().get())


@atexit.register
def _leave() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None and _made:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            for path in _made:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session is gone; its folders stay
        pass


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions in use, at least the cores at hand."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
