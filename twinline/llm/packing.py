"""Problem 8: items of varying length in containers of fixed capacity (vector bin packing, dot-product heuristic).

A container is limited in three ways at once: tokens, number of segments, and loss-bearing tokens. Loss-bearing is a
document's last block, blocks being parted by empty lines: what comes before is its prompt, the last block its
completion, and a text of one block is all completion. Containers are filled one after the other. The next item is,
of those that fit in all three, the one whose demand vector has the largest dot product with what is still free, both
as shares of the limits; ties go to the larger item, then the first id (as a string).

Only an item longer than the capacity is split, into full pieces and a rest. An item that alone has more
loss-bearing tokens than the limit counts as the limit: it is kept whole, and shares its container only with items
that have none. Items without tokens take no room: they are given with a null container.

Items are dealt by the hash of their id to shards of about SHARD_ITEMS, each packed on its own in one task, so
no task sees more than a bounded part of the corpus; the price is at most a few unfilled containers a shard.
Items of equal or null id are packed like any others, an empty table gives no rows, and other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.llm.encoding import NAME, TOKENIZERS, byte_lengths, encode, encoder

CAPACITY = 2048
#: Both limits bind for some containers of the given documents, which hold 4 segments and 600 loss-bearing tokens on average.
MOST_SEGMENTS = 12
MOST_LOSS = 1024
SHARD_ITEMS = 4096
MOST_TASKS = 20_000

_LAST_BLOCK = regex.compile(r"(?r)\n[^\S\n]*\n\s*(?=\S)")


def prompt_bytes(text: str) -> int:
    """How many bytes of a text come before its last block."""
    m = _LAST_BLOCK.search(text)
    return len(text[: m.end()].encode()) if m else 0


def sizes(df: DataFrame, id_: str, text: str, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(id, n_tokens, n_prompt): tokens of each text and of those the ones that begin before its last block. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        long = byte_lengths(folder, name)
        for batch in batches:
            counts = np.zeros((2, batch.num_rows), np.int32)
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    ids = encode(enc, t)
                    begins = np.cumsum(long[ids]) - long[ids]
                    counts[:, i] = len(ids), np.searchsorted(begins, prompt_bytes(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts[0]), pa.array(counts[1])], [id_, "n_tokens", "n_prompt"])

    return df.select(F.col(id_).cast("long"), text).mapInArrow(run, f"{id_} long, n_tokens int, n_prompt int")


def fill(demand: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The container of each item. Every item fits in an empty container. Items come by falling first demand."""
    n = len(demand)
    share = (demand / capacity).astype(np.float32)
    first = np.argsort(-share.sum(axis=1), kind="stable").tolist()  # what is best for an empty container
    left = np.ones(n, bool)
    where = np.zeros(n, np.int64)
    pool, size = np.arange(n), -demand[:, 0]
    container = taken = at = 0
    free = capacity.astype(np.int64).copy()
    for _ in range(n):
        if len(pool) > 2 * (n - taken) + 16:
            pool = pool[left[pool]]
            size = -demand[pool, 0]
        best = -1
        if taken and (free > 0).any():
            some = pool[np.searchsorted(size, -free[0]) :]
            some = some[left[some] & (demand[some, 1:] <= free[1:]).all(axis=1)]
            if len(some):
                best = some[np.argmax(share[some] @ (free / capacity).astype(np.float32))]
        if best < 0:
            while not left[first[at]]:
                at += 1
            best, free, container = first[at], capacity.astype(np.int64).copy(), container + (taken > 0)
        left[best], where[best] = False, container
        free -= demand[best]
        taken += 1
    return where


def counted_loss(limit: int = MOST_LOSS) -> Column:
    """The loss-bearing tokens that an item brings to its container."""
    return F.least(F.col("n_loss"), F.lit(limit))


def pack(items: DataFrame, id_: str, capacity: int = CAPACITY, segments: int = MOST_SEGMENTS, loss: int = MOST_LOSS) -> DataFrame:
    """(id, part_no, start_token, n_tokens, n_loss, container_id, slot) from (id, n_tokens, n_prompt)."""
    pieces = items.select(id_, "n_tokens", "n_prompt", F.posexplode(F.when(F.col("n_tokens") > 0, F.sequence(F.lit(0), F.col("n_tokens") - 1, F.lit(capacity))).otherwise(F.array(F.lit(0)))).alias("part_no", "start_token"))
    size = F.least(F.lit(capacity), F.col("n_tokens") - F.col("start_token"))
    pieces = pieces.withColumn("n", size).withColumn("n_loss", F.greatest(F.lit(0), F.col("n") - F.greatest(F.lit(0), F.col("n_prompt") - F.col("start_token"))))
    pieces = pieces.select(F.col(id_).cast("string").alias("id"), "part_no", "start_token", F.col("n").alias("n_tokens"), "n_loss")
    shards = max(1, -(-items.count() // SHARD_ITEMS))
    bounds = np.array([capacity, segments, loss])

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "part_no"], ascending=[False, True, True], kind="stable", ignore_index=True)
        some = pdf["n_tokens"].to_numpy() > 0
        demand = np.column_stack([pdf["n_tokens"], np.ones(len(pdf)), np.minimum(pdf["n_loss"], loss)]).astype(np.int64)[some]
        at = np.full(len(pdf), -1, np.int64)
        at[some] = fill(demand, bounds)
        pdf["slot"] = pd.Series(at).groupby(at).cumcount()
        container = pd.array(at + pdf["shard"].to_numpy().astype(np.int64) * (1 << 32), "Int64")
        container[~some] = pd.NA
        pdf["container_id"] = container
        return pdf[["id", "part_no", "start_token", "n_tokens", "n_loss", "container_id", "slot"]]

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "part_no"), F.lit(shards)).cast("int"))
    schema = "id string, part_no int, start_token int, n_tokens int, n_loss int, container_id long, slot long"
    dealt = dealt.repartition(min(shards, MOST_TASKS), "shard")  # a number given is not coalesced: packing costs CPU, not bytes
    return dealt.groupBy("shard").applyInPandas(shard, schema).withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_)
