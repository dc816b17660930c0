import collections
import random

from pyspark.sql import functions as F

from twinline.operators.skew import dominating, ordered_totals, partial_states, salted_join

SCHEMA = "k string, f string, id long, w long, key_val string, d string, pid int"


def brute(data):
    out = {}
    for k in {r[0] for r in data} - {None}:
        own = [r for r in data if r[0] == k]
        out[k] = (len(own), len({r[1] for r in own} - {None}), sum(r[3] or 0 for r in own))
    return out


def totals(df, parts=8):
    return ordered_totals(df, F.col("k"), F.col("f"), F.col("id"), F.col("w"), parts)


def as_dict(df):
    return {r.key_val: (r.n_rows, r.n_distinct, r.total) for r in df.collect()}


def test_heavy_keys_over_many_partitions(rows):
    rng = random.Random(5)
    # One key has two thirds of the rows, one value of it most of those: both run over many partitions.
    data = [("hot" if i % 3 else rng.choice(["a", "b", "", None]), rng.choice(["x"] * 8 + ["y", None]), i, rng.choice([1, 2, None]), "clash", "clash", 1) for i in range(3000)]
    assert as_dict(totals(rows(data, SCHEMA))) == brute(data)
    assert as_dict(totals(rows(data, SCHEMA), 1)) == brute(data)


def test_ties_repeats_and_emptiness(rows):
    data = [("a", "x", 1, 1, "", "", 0)] * 50 + [(None, "x", 1, 1, "", "", 0)] * 3
    assert as_dict(totals(rows(data, SCHEMA))) == brute(data)
    assert totals(rows([], SCHEMA)).count() == 0


def test_the_states_of_a_heavy_key_are_spread(rows):
    """The operator's own range partitions hold about as many rows each, though one key has all."""
    data = [("hot", f"f{i % 50}", i, 1, "", "", 0) for i in range(4000)]
    states = partial_states(rows(data, SCHEMA), F.col("k"), F.col("f"), F.col("id"), parts=8).collect()
    assert len(states) == 8 and max(s.n for s in states) < 1000 and sum(s.n for s in states) == 4000


def test_dominating(rows):
    t = rows([("a", 96), ("b", 4), ("c", 0)], "key_val string, n long")
    assert {r.key_val for r in dominating(t, "n", 0.04).collect()} == {"a", "b"}


def test_salted_join_is_a_join(rows):
    big = rows([(1, i) for i in range(500)] + [(k, k) for k in range(2, 50)] + [(None, 1)], "key long, i long")
    small = rows([(k, f"v{k}") for k in range(0, 40)], "key long, v string")
    counts = big.groupBy("key").agg(F.count("*").alias("n"))
    for least in (1, 100, 1000):
        got = salted_join(big, small, "key", counts, F.col("i"), least=least)
        want = big.join(small, "key")
        assert collections.Counter(map(tuple, got.select("key", "i", "v").collect())) == collections.Counter(map(tuple, want.select("key", "i", "v").collect()))
    assert salted_join(big.limit(0), small, "key", counts.limit(0), F.col("i")).count() == 0


def test_salted_join_cuts_a_hot_key(spark, rows):
    """A key with nine tenths of the rows is cut into pieces of half a partition, by its share and not by a fixed number."""
    big = rows([(1, i) for i in range(9000)] + [(k, k) for k in range(2, 1002)], "key long, i long")
    small = rows([(k, f"v{k}") for k in range(0, 2000)], "key long, v string")
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        got = salted_join(big, small, "key", big.groupBy("key").agg(F.count("*").alias("n")), F.col("i"))
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 10_000 and max(sizes) < 2500
