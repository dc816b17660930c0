"""Files as DataFrames, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.functions.text import slug_of
from twinline.schemas import LABELLED, MANIFEST, REPOS, require_columns


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return require_columns(df, *columns).select(*columns) if columns else df


def last_per_key(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of each key by order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("x")).select(key, "x.*")


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    """Repository metadata from CSV with a header, with repo_slug; the last line of a slug counts."""
    rows = spark.read.csv(path, header=True, schema=REPOS, multiLine=True, escape='"').withColumn("pos", F.monotonically_increasing_id())
    return last_per_key(rows.withColumn("repo_slug", slug_of(F.col("full_name"))), "repo_slug", ["pos"]).drop("pos")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Clone manifest from JSON lines; malformed lines are skipped, the last line of a repository counts."""
    rows = spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(path).withColumn("pos", F.monotonically_increasing_id())
    return last_per_key(rows.filter("full_name IS NOT NULL").withColumn("repo_slug", slug_of(F.col("full_name"))), "repo_slug", ["pos"]).drop("pos")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs from JSON lines; ValueError if there are none or cos, lev or label is missing."""
    found = spark.read.json(path)
    require_columns(found, "cos", "lev", "label")
    if not found.head(1):
        raise ValueError("no labelled pairs")
    return spark.read.schema(LABELLED).json(path)


def read_artefact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)
