"""Sampling of candidate pairs. Order and choice depend on a seed and the rows only, never on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinline.functions.edit import indel_ratio_raw
from twinline.functions.text import normalise
from twinline.functions.vectors import EmbedFn, dot, hashed_ngrams
from twinline.operators.cluster import embed
from twinline.operators.pairs import band_of, cosine_pairs

PER_BAND = 34
POOL = 20_000


def distinct_texts(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.select(normalise(F.col(text)).alias("text")).filter("text <> ''").distinct()


def per_stratum(rows: DataFrame, stratum: str, n: int, key: list[Column], seed: int = 42) -> DataFrame:
    """n rows of each stratum in seeded order, ties by key. The window's limit is applied before the shuffle too."""
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), *key), *key)
    return rows.filter(F.col(stratum).isNotNull()).withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= n).drop("__i")


def random_pairs(texts: DataFrame, vectors: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(a, b, cos) of up to n random pairs of texts, by two seeded draws of positions and two equi-joins."""
    w = Window.partitionBy("part").orderBy("h", "text")
    dealt = texts.select("text", F.xxhash64(F.lit(seed), "text").alias("h")).withColumn("part", F.pmod("h", F.lit(64)))
    sizes = {r[0]: r[1] for r in dealt.groupBy("part").count().collect()}  # at most 64 rows
    total, start = 0, {}
    for p in sorted(sizes):
        start[p], total = total, total + sizes[p]
    if total < 2:
        return texts.select(F.col("text").alias("a"), F.col("text").alias("b"), F.lit(0.0).alias("cos")).limit(0)
    offset = F.create_map(*(F.lit(x) for kv in start.items() for x in kv))
    placed = dealt.select("text", (F.row_number().over(w) - 1 + F.element_at(offset, F.col("part"))).alias("at"))
    draws = texts.sparkSession.range(n).select(*(F.pmod(F.xxhash64(F.lit(seed + s), "id"), F.lit(total)).alias(c) for s, c in ((1, "i"), (2, "j")))).filter("i <> j")
    draws = draws.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    a, b = (placed.join(vectors, placed["text"] == vectors["key"]).select(F.col("at").alias(k), F.col("text").alias(t), F.col("vector").alias(v)) for k, t, v in (("i", "a", "va"), ("j", "b", "vb")))
    return draws.join(a, "i").join(b, "j").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), dot(F.col("va"), F.col("vb")).alias("cos"))


def sample_pairs(rows: DataFrame, per_band: int = PER_BAND, pool: int = POOL, draws: int = 100_000, fn: EmbedFn = hashed_ngrams, seed: int = 42, text: str = "text") -> DataFrame:
    """(id, text_a, text_b, cos, lev, cos_band): pairs from each band of the cosine.

    A seeded pool of at most ``pool`` distinct texts is compared in full from 0.5 on; random pairs add to the
    lowest band. Sampling is the purpose of this operator: pool and per_band are its parameters.
    """
    texts = distinct_texts(rows, text)
    picked = texts.orderBy(F.xxhash64(F.lit(seed), "text"), "text").limit(pool)
    vectors = embed(picked, "text", fn)
    close = cosine_pairs(vectors, "key", "vector", 0.5)
    extra = random_pairs(picked, vectors, draws, seed).filter("cos >= 0.5 AND cos < 0.7")
    pairs = close.unionByName(extra).dropDuplicates(["a", "b"]).withColumn("cos_band", band_of(F.col("cos"), 1.0))
    chosen = per_stratum(pairs, "cos_band", per_band, [F.col("a"), F.col("b")], seed)
    w = Window.orderBy("cos_band", "a", "b")  # per_band rows a band
    return chosen.select((F.row_number().over(w) - 1).cast("long").alias("id"), F.col("a").alias("text_a"), F.col("b").alias("text_b"), F.round("cos", 4).alias("cos"), F.round(indel_ratio_raw(F.col("a"), F.col("b")), 4).alias("lev"), "cos_band")
