"""Problem 6: pairs and groups of texts that share most of their words (circulant MinHash).

Word sets are the units: texts with equal sets form a class, and only one set a class is compared. A word is a 64-bit
number. A first permutation of all these numbers is followed by a second one, shifted circularly by 0, 1, 2, ..., each
shift giving one coordinate of the signature, so that two permutations do for all of them. Both are bijections of the
64-bit numbers, so no two words ever share a position. Bands of the signature make buckets, in which candidates
meet, and every pair is verified by its exact similarity. With 56 bands of 7 coordinates a pair at the threshold of
0.8 is missed with probability 2e-6, and a pair at 0.2 becomes a candidate with 7e-4. No bucket is capped.

For pairs, a bucket is cut into blocks of at most BLOCK sets, and each pair of blocks is joined by itself; so are the
rows of two classes. For groups not all pairs are listed: each bucket's smallest class leads it and is compared with
all others, which is linear in the bucket. Where the classes of a bucket then still lie in several groups, the
smallest class of those outside the leader's group leads next, and after ROUNDS rounds the pairs of a bucket that
are in different groups are compared in blocks. So a template with any number of variants costs one comparison a
variant and band, and groups are those of all similar pairs that meet in a bucket.

Null texts have no words, and rows without an id no pairs. Texts without words are similar to equal texts only.
Texts are taken whole, ties at the threshold are pairs, an empty table gives no rows, other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.operators.graph import connected_components
from twinline.operators.skew import salted_join
from twinline.session import cut

BANDS, ROWS = 56, 7
BLOCK = 1000
ROUNDS = 3
SEED = 20_240
#: Similarity as a fraction, so that the comparison is exact.
LEAST = (4, 5)


def word_set(text: Column) -> Column:
    """Sorted hashes of the distinct words, longest runs of letters and digits, lower-cased."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))
    hashed = F.array_sort(F.transform(words, lambda w: F.xxhash64(w)))
    return F.when(F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", "")) > 0, hashed).when(text.isNotNull(), F.array(F.xxhash64(F.lit("no words"), text)))


def similar(a: Column, b: Column) -> Column:
    """Whether two word sets reach the least similarity."""
    both = F.size(F.array_intersect(a, b))
    return both * LEAST[1] >= (F.size(a) + F.size(b) - both) * LEAST[0]


def _permuted(x: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers: each step, a product with an odd number or an exclusive or with the upper bits, can be undone."""
    x = x * odd[0]
    x ^= x >> np.uint64(32)
    x *= odd[1]
    x ^= x >> np.uint64(29)
    return x * odd[2]


def signatures(flat: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """The k coordinates of each set; sets are non-empty and follow each other in flat."""
    odd = np.random.default_rng(SEED).integers(1, 2**63, (2, 3), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    position = _permuted(flat.view(np.uint64), odd[0])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sizes), k), np.uint64)
    # A shift of the position adds a constant to its product, the first step of the second permutation.
    product, shifts = position * odd[1, 0], odd[1, 0] * np.arange(k, dtype=np.uint64)
    for i in range(k):
        x = product + shifts[i]
        x ^= x >> np.uint64(32)
        x *= odd[1, 1]
        x ^= x >> np.uint64(29)
        x *= odd[1, 2]
        out[:, i] = np.minimum.reduceat(x, starts)
    return out


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word set the hashes of its bands."""
    mix = np.random.default_rng(SEED + 1).integers(1, 2**63, (2, BANDS), dtype=np.uint64) | np.uint64(1)
    for batch in batches:
        sets = batch.column(1)
        flat = sets.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(sets.offsets.to_numpy())
        ends = np.cumsum(sizes, dtype=np.int64)
        for a in range(0, len(sizes), 1000):
            b = min(a + 1000, len(sizes))
            coordinates = signatures(flat[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b], BANDS * ROWS)
            out = np.zeros((b - a, BANDS), np.uint64)
            for r in range(ROWS):
                out = (out ^ coordinates[:, r::ROWS]) * mix[0] + mix[1]
                out ^= out >> np.uint64(29)
            hashes = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), hashes], ["class_id", "keys"])


def classes(df: DataFrame, id_: Column, text: Column) -> tuple[DataFrame, DataFrame]:
    """(id, class_id) of every text, and (class_id, words) of every class; a class is named by its smallest id."""
    rows = cut(df.select(id_.cast("long").alias("id"), word_set(text).alias("words")).filter("words IS NOT NULL AND id IS NOT NULL"))
    sets = cut(rows.groupBy("words").agg(F.min("id").alias("class_id"), F.count("*").alias("n")).select("class_id", "words", "n"))
    several = sets.filter("n > 1").select("words", "class_id")
    members = salted_join(rows, several, "words", sets.select("words", "n"), F.col("id")).select("id", "class_id").unionByName(sets.filter("n = 1").select(F.col("class_id").alias("id"), "class_id"))
    return members, sets.select("class_id", "words")


def buckets(sets: DataFrame) -> DataFrame:
    """(key, class_id): the buckets of each class that it shares with another one."""
    bands = cut(sets.select("class_id", "words").mapInArrow(_bands, "class_id long, keys array<long>"))
    keyed = bands.select("class_id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return cut(salted_join(keyed, shared, "key", shared, F.col("class_id")))


def in_blocks(left: DataFrame, right: DataFrame, key: str, a: str, b: str, blocks: Column, same: bool) -> DataFrame:
    """left and right joined on key, block by block; blocks is the number of blocks of a key, in both sides.

    Rows of left are dealt to blocks by a, rows of right by b, and a row is given to each pair with a block of the
    other side. Where left and right hold the same rows, same, only blocks in order meet, each pair of rows once or,
    within a block, twice.
    """
    own = lambda c: F.pmod(F.xxhash64(c), F.col("__n")).cast("int")
    x = left.withColumn("__n", blocks.cast("int")).withColumn("__i", own(a)).withColumn("__j", F.explode(F.sequence(F.col("__i") if same else F.lit(0), F.col("__n") - 1))).drop("__n", "n")
    y = right.withColumn("__n", blocks.cast("int")).withColumn("__j", own(b)).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__j") if same else F.col("__n") - 1))).drop("__n", "n")
    return x.join(y, [key, "__i", "__j"]).drop("__i", "__j")


def _verified(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidates (a, b) that are similar. A class with many candidates is cut into pieces."""
    both = candidates
    for c, other in (("a", "b"), ("b", "a")):
        own = sets.select(F.col("class_id").alias(c), F.col("words").alias(f"w{c}"))
        both = salted_join(both, own, c, candidates.groupBy(c).agg(F.count("*").alias("n")), F.col(other))
    return both.filter(similar(F.col("wa"), F.col("wb"))).select("a", "b")


def bucket_pairs(keyed: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of classes in a bucket, once."""
    blocks = F.ceil(F.col("n") / BLOCK)
    left, right = keyed.select("key", "n", F.col("class_id").alias("a")), keyed.select("key", "n", F.col("class_id").alias("b"))
    met = in_blocks(left, right, "key", "a", "b", blocks, True)
    return met.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def class_pairs(sets: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of classes that reach the least similarity."""
    return _verified(cut(bucket_pairs(buckets(sets))), sets)


def id_pairs(df: DataFrame, id_: Column, text: Column) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows, those with equal word sets included."""
    members, sets = classes(df, id_, text)
    members = cut(members)
    rows = members.groupBy("class_id").agg(F.count("*").alias("n"))
    sized = cut(salted_join(members, rows, "class_id", rows, F.col("id")))
    blocks = F.ceil(F.col("n") / BLOCK)
    several = sized.filter("n > 1")
    same = in_blocks(several.select("class_id", "n", F.col("id").alias("x")), several.select("class_id", "n", F.col("id").alias("y")), "class_id", "x", "y", blocks, True)
    same = same.filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
    # Of two classes, the blocks of the first meet the rows of the second, which then come block by block too.
    a = sized.select(F.col("class_id").alias("a"), F.pmod(F.xxhash64("id"), blocks).alias("i"), F.col("id").alias("x"))
    b = sized.select(F.col("class_id").alias("b"), F.pmod(F.xxhash64("id"), blocks).alias("j"), F.col("id").alias("y"))
    na, nb = (rows.select(F.col("class_id").alias(c), F.sequence(F.lit(0), (blocks - 1).cast("int")).alias(f"n{c}")) for c in "ab")
    links = class_pairs(sets).join(na, "a").join(nb, "b").withColumn("i", F.explode("na")).withColumn("j", F.explode("nb")).drop("na", "nb")
    apart = links.join(a, ["a", "i"]).join(b, ["b", "j"]).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return same.unionByName(apart)


def _with_groups(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """keyed with the group of each class, by the links found so far."""
    found = connected_components(links, "a", "b").select(F.col("node").alias("class_id"), F.col("component").alias("g"))
    return keyed.join(found, "class_id", "left").withColumn("g", F.coalesce("g", "class_id"))


def class_links(sets: DataFrame) -> DataFrame:
    """(a, b): similar pairs of classes that hold together what all similar pairs in buckets do."""
    keyed = buckets(sets)
    links = None
    grouped = keyed.withColumn("g", F.col("class_id"))
    for round_ in range(ROUNDS):
        # The leader is the smallest class; later on, the smallest of those outside the group of the bucket's smallest one.
        lead = grouped.groupBy("key").agg(F.min(F.struct("class_id", "g")).alias("lead"), F.count("*").alias("n"))
        if round_:
            rest = salted_join(grouped, lead.select("key", F.col("lead.g").alias("lead_g")), "key", lead.select("key", "n"), F.col("class_id")).filter("g <> lead_g")
            lead = rest.groupBy("key").agg(F.min(F.struct("class_id", "g")).alias("lead")).join(lead.select("key", "n"), "key")
        near = salted_join(grouped, lead.select("key", "lead"), "key", lead.select("key", "n"), F.col("class_id")).filter("g <> lead.g")
        pairs = cut(near.select(F.least("class_id", "lead.class_id").alias("a"), F.greatest("class_id", "lead.class_id").alias("b")).distinct())
        new = _verified(pairs, sets)
        links = cut(new if links is None else links.unionByName(new))
        grouped = _with_groups(keyed, links)
        # Only buckets whose classes lie in several groups have anything left to compare.
        mixed = grouped.groupBy("key").agg(F.min("g").alias("p"), F.max("g").alias("q"), F.count("*").alias("n")).filter("p <> q").select("key", "n")
        grouped = cut(salted_join(grouped.drop("n"), mixed, "key", mixed, F.col("class_id")))
        if not grouped.head(1):
            return links
        keyed = grouped.drop("g")
    met = in_blocks(grouped.select("key", "n", "g", F.col("class_id").alias("a")), grouped.select("key", "n", F.col("g").alias("h"), F.col("class_id").alias("b")), "key", "a", "b", F.ceil(F.col("n") / BLOCK), True)
    left = met.filter("g <> h").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return links.unionByName(_verified(cut(left), sets))


def groups(df: DataFrame, id_: Column, text: Column) -> DataFrame:
    """One row per text: id, class_id (smallest id with the same words) and group_id (smallest class reached over similar ones)."""
    members, sets = classes(df, id_, text)
    found = connected_components(class_links(sets), "a", "b").select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    return members.join(found, "class_id", "left").select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"))
