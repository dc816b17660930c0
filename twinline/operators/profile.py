"""Profiles of clusters and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinline.functions.text import normalise, strip_ends
from twinline.operators.ids import before


def cluster_profile(rows: DataFrame, group: str, canonical: str, position: Column, examples: int = 5) -> DataFrame:
    """Distinct repositories and texts, examples, licence mix of each group.

    Examples are the first other texts in code-point order. The top licence class has most rows; ties go to the
    one met first by position. Rows without a licence class count as unknown.
    """
    rows = rows.withColumn("license_class", F.coalesce("license_class", F.lit("unknown")))
    texts = rows.groupBy(group, canonical, "text").agg(F.count("*").alias("n"))
    # Only the first texts of each group are kept: the window sees distinct texts, and its limit is pushed below the shuffle.
    w = Window.partitionBy(group).orderBy("text")
    first = texts.filter(F.col("text") != F.col(canonical)).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= examples)
    shown = first.groupBy(group).agg(F.array_sort(F.collect_list("text")).alias("member_examples"))
    variants = texts.groupBy(group).agg(F.count("text").alias("n_distinct_variants"), F.sum("n").alias("count"))
    repos = rows.select(group, "repo_slug").distinct().groupBy(group).agg(F.count("repo_slug").alias("n_distinct_repos"))
    classes = rows.groupBy(group, "license_class").agg(F.count("*").alias("n"), F.min(position).alias("at"))
    top = classes.groupBy(group).agg(
        F.min_by("license_class", F.struct((-F.col("n")).alias("n"), "at", "license_class")).alias("top_license_class"),
        (F.sum(F.when(F.col("license_class") == "permissive", F.col("n")).otherwise(0)) / F.sum("n")).alias("permissive_fraction"),
    )
    none = F.array().cast("array<string>")
    return variants.join(repos, group).join(top, group).join(shown, group, "left").withColumn("member_examples", F.coalesce("member_examples", none))


def duplication(rows: DataFrame, group: str | None = None, text: str = "text") -> DataFrame:
    """n_steps, n_unique and dup_rate overall or by group; texts are compared without white space at their ends."""
    keys = [group] if group else []
    by_text = rows.filter(F.col(text).isNotNull()).groupBy(*keys, strip_ends(F.col(text)).alias("t")).agg(F.count("*").alias("n"))
    rate = F.when(F.coalesce(F.sum("n"), F.lit(0)) == 0, 0.0).otherwise(1 - F.count("*") / F.sum("n"))
    return by_text.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_steps"), F.count("*").alias("n_unique"), rate.alias("dup_rate"))


def licence_strata(steps: DataFrame) -> DataFrame:
    """Overall and by licence class: steps, repositories, unique texts, rate, exact clusters and the steps in them."""
    rows = steps.filter("text IS NOT NULL").select("license_class", "repo_slug", "text")
    both = rows.select(F.explode(F.array(F.lit("overall"), "license_class")).alias("stratum"), "repo_slug", "text").filter("stratum IS NOT NULL")
    base = duplication(both, "stratum")
    repos = both.select("stratum", "repo_slug").distinct().groupBy("stratum").agg(F.count("repo_slug").alias("n_repos"))
    counted = both.withColumn("norm", normalise(F.col("text"))).filter("norm <> ''").groupBy("stratum", "norm").agg(F.count("*").alias("n")).filter("n >= 2")
    found = counted.groupBy("stratum").agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_clustered"))
    return base.join(repos, "stratum").join(found, "stratum", "left").fillna(0, ["n_clusters", "n_clustered"])


def top_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; the limit is applied before and after the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def length_profile(rows: DataFrame, text: str = "text") -> DataFrame:
    """Percentiles of the text length, with linear interpolation. One row a length is aggregated, not one a text."""
    sizes = rows.filter(F.col(text).isNotNull()).groupBy(F.length(text).alias("len")).agg(F.count("*").alias("n"))
    return sizes.agg(*(F.expr(f"percentile(len, {p}, n)").alias(f"p{int(100 * p)}") for p in (0.5, 0.9, 0.95, 0.99)), F.max("len").alias("longest"))


def length_histogram(rows: DataFrame, text: str = "text", bins: int = 79, top: float = 3.5) -> DataFrame:
    """(bin, n): text lengths in bins of equal width on a logarithmic scale from 1 to 10^top; both ends are included."""
    sizes = rows.filter(F.length(text) >= 1).groupBy(F.length(text).alias("len")).agg(F.count("*").alias("n")).filter(F.log10("len") <= top)
    at = F.least(F.floor(F.log10("len") * bins / top), F.lit(bins - 1)).cast("int")
    return sizes.groupBy(at.alias("bin")).agg(F.sum("n").alias("n"))


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with the rank of a value, ties averaged. Ranks come from one row a distinct value, in range partitions."""
    sizes = before(rows.groupBy(value).agg(F.count("*").alias("__n")), [F.col(value)], F.col("__n"), "__before")
    return rows.join(sizes.select(value, (F.col("__before") + (F.col("__n") + 1) / 2).alias(name)), value)
