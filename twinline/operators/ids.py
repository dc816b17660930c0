"""Sequential numbers and running totals in a global order, without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinline.session import cut, partitions


def before(rows: DataFrame, order: list[Column], weight: Column, name: str) -> DataFrame:
    """rows with the sum of the weights, whole numbers, of all rows that come before in order.

    Rows are range-partitioned and sorted; each partition starts with the total of those before it. The order should
    be total, else rows that tie are placed in any order. An empty table gives no rows.
    """
    parts = cut(rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("__part", F.spark_partition_id()).withColumn("__w", weight.cast("long")))
    sums = dict(parts.groupBy("__part").agg(F.sum("__w")).collect())  # one row a partition
    first, total = {}, 0
    for p in sorted(sums):
        first[p] = total
        total += sums[p] or 0
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in first.items() for x in kv)), F.col("__part")) if first else F.lit(0)
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(name, (offset + F.coalesce(F.sum("__w").over(w), F.lit(0))).cast("long")).drop("__part", "__w")


def numbered(rows: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """rows with their number in order."""
    return before(rows, order, F.lit(1), name).withColumn(name, F.col(name) + start)
