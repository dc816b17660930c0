"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.operators.skew import LEAST_HOT, salted_join
from twinline.session import cut

#: Graphs up to this many links are finished in one task, which takes a few MB; larger ones take rounds of joins.
ONE_TASK = 100_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reached.

    Alternating large-star and small-star steps until nothing changes, which takes a logarithmic number of
    rounds, also on long chains. A hub's links are cut into pieces (see salted_join). Each round's edges are
    checkpointed to the shared folder, so that a lost executor costs one round. Edges with a null end and loops
    are left out; nodes without edges are their own component and are for the caller to add. No edges give no rows.
    """
    links = cut(
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    if links.count() <= one_task:
        kind = dict(links.dtypes)["u"]
        return links.coalesce(1).mapInArrow(_united, f"node {kind}, component {kind}")
    before = None
    while True:
        links = cut(_small_star(cut(_large_star(links))))
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components by union and find, the smaller root on top."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in up], kind)], ["node", "component"])


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """links with m, the smallest neighbour of u, from least (u, m, n). Only where there are hubs are they cut into pieces."""
    least = cut(least)
    if (least.agg(F.max("n")).first()[0] or 0) < LEAST_HOT:
        return links.join(least.select("u", "m"), "u")
    return salted_join(links, least.select("u", "m"), "u", least.select("u", "n"), F.col("v"))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour, itself included."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. A link's u is the larger end."""
    near = _with_least(links, links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    moved = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v"))).distinct()
