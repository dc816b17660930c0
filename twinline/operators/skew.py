"""Per-key results although a few keys hold most of the rows.

``ordered_totals`` range-partitions rows on (key, secondary order) with the quantiles that Spark samples for
``repartitionByRange``. As the order beyond the key takes part, a key that holds a third of all rows is cut
over a third of the partitions. Each partition is sorted and reduced, in one streaming pass, to one partial
state per key with the first and last value of the counted column; the few states of a key are stitched
afterwards, so that a value that runs over a partition boundary counts once.

``salted_join`` joins rows with a side of unique keys and cuts every key that holds more than half of an even
partition into pieces of that size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinline.session import partitions

#: A key with fewer rows is never cut, whatever its share.
LEAST_HOT = 1000


def ordered_totals(df: DataFrame, key: Column, distinct: Column, order: Column, weight: Column | None = None, parts: int | None = None) -> DataFrame:
    """One row per key: key_val, n_rows, n_distinct, total.

    n_rows counts the rows of the key, n_distinct the different non-null values of ``distinct``, total adds up
    ``weight`` (nulls count 0; 1 a row without a weight). Rows with a null key are left out: they belong to no
    key. A blank or empty key is a key like any other. ``order`` breaks ties between rows of equal key and
    ``distinct``, so that even those rows can be cut over partitions. Other columns of df, whatever their
    names, play no part. An empty table gives no rows.
    """
    states = partial_states(df, key, distinct, order, weight, parts)
    # A key's states, at most one a partition, in partition order: a boundary value counts in both neighbours.
    w = Window.partitionBy("key_val").orderBy("pid")
    stitched = states.withColumn("twice", (F.lag("last").over(w) == F.col("first")).cast("long"))
    return stitched.groupBy("key_val").agg(
        F.sum("n").alias("n_rows"),
        (F.sum("distinct") - F.coalesce(F.sum("twice"), F.lit(0))).alias("n_distinct"),
        F.sum("total").alias("total"),
    )


def partial_states(df: DataFrame, key: Column, distinct: Column, order: Column, weight: Column | None = None, parts: int | None = None) -> DataFrame:
    """The states of each range partition, pid: one a key, with its rows, different values, weight, first and last value."""
    rows = df.select(
        key.cast("string").alias("key_val"),
        distinct.cast("string").alias("d"),
        order.alias("o"),
        (F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))).cast("long").alias("w"),
    ).filter("key_val IS NOT NULL")
    n = parts or partitions(df.sparkSession)
    cut = rows.repartitionByRange(n, "key_val", "d", "o").sortWithinPartitions("key_val", "d").select("key_val", "d", "w")
    return cut.withColumn("pid", F.spark_partition_id()).mapInPandas(_states, _STATE)


_STATE = T.StructType([
    T.StructField("pid", T.IntegerType()),
    T.StructField("key_val", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("distinct", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("first", T.StringType()),
    T.StructField("last", T.StringType()),
])


def _states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial states of one sorted partition. Only the key that is still open is carried from batch to batch."""
    open_: dict | None = None
    for b in batches:
        if b.empty:
            continue
        same_key = b["key_val"].eq(b["key_val"].shift())
        fresh = b["d"].notna() & ~(same_key & b["d"].eq(b["d"].shift()))
        g = b.assign(fresh=fresh, run=(~same_key).cumsum()).groupby("run", sort=False)
        out = pd.DataFrame({
            "pid": g["pid"].first(), "key_val": g["key_val"].first(), "n": g.size(), "distinct": g["fresh"].sum(),
            "total": g["w"].sum(), "first": g["d"].first(), "last": g["d"].last(),
        }).astype(object).where(lambda x: x.notna(), None).to_dict("records")
        if open_ is not None and open_["key_val"] == out[0]["key_val"]:
            head = out[0]
            head["distinct"] += open_["distinct"] - (head["first"] is not None and head["first"] == open_["last"])
            head["n"] += open_["n"]
            head["total"] += open_["total"]
            head["first"] = open_["first"] if open_["first"] is not None else head["first"]
            head["last"] = head["last"] if head["last"] is not None else open_["last"]
        elif open_ is not None:
            out.insert(0, open_)
        open_ = out.pop()
        if out:
            yield pd.DataFrame(out)
    if open_ is not None:
        yield pd.DataFrame([open_])


def dominating(totals: DataFrame, measure: str, share: float) -> DataFrame:
    """The rows of totals whose measure is at least share of the sum over all of them."""
    whole = totals.agg(F.sum(measure).alias("whole")).scalar()
    return totals.filter(F.col(measure) >= F.lit(share) * whole)


def salted_join(big: DataFrame, small: DataFrame, on: str, counts: DataFrame, spread: Column, how: str = "inner", least: int = LEAST_HOT) -> DataFrame:
    """big joined with small on one column; small has each key once, null keys join nothing.

    counts has (on, n), the number of big's rows of each key; keys that only small has may be missing. A key is hot
    if it holds at least ``least`` rows and half of an even partition. So no more than twice as many keys as there
    are partitions can be hot, and a row for each is broadcast. Rows of big with a hot key are spread by ``spread``
    over pieces of half a partition, and small's row of that key is repeated once a piece.
    """
    pieces = F.ceil(F.col("n") * (2 * partitions(big.sparkSession)) / counts.agg(F.sum("n")).scalar()).cast("int")
    hot = F.broadcast(counts.filter(F.col("n") >= least).select(F.col(on).alias("__hot"), pieces.alias("__pieces")).filter("__pieces > 1"))
    left = big.join(hot, F.col(on) == F.col("__hot"), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__pieces")), F.lit(0)).cast("int")).drop("__hot", "__pieces")
    right = small.join(hot, F.col(on) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1))).drop("__hot", "__pieces")
    return left.join(right, [on, "__salt"], how).drop("__salt")
