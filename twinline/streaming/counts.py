"""Extension: exact clusters of a stream of steps, kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.functions.text import normalise


def stream_counts(steps: DataFrame, min_count: int = 2) -> DataFrame:
    """(canonical_text, count) of a streaming DataFrame; for output modes complete and update.

    State is one number a distinct text, kept by the state store and recovered from its checkpoint.
    """
    return steps.withColumn("canonical_text", normalise(F.col("text"))).filter("canonical_text <> ''").groupBy("canonical_text").agg(F.count("*").alias("count")).filter(F.col("count") >= min_count)


def windowed_counts(steps: DataFrame, time: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, canonical_text, count) by event time; steps later than ``late`` are left out. For output mode append."""
    rows = steps.withWatermark(time, late).withColumn("canonical_text", normalise(F.col("text"))).filter("canonical_text <> ''")
    return rows.groupBy(F.window(time, width), "canonical_text").agg(F.count("*").alias("count")).select(F.col("window.start").alias("start"), "canonical_text", "count")
