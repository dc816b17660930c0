import datetime

from pyspark.sql import functions as F

from twinline.llm import survivors as s

SCHEMA = "g long, id long, text string, lic string, sha string, t timestamp, full int, n long, row string, n_current int, place string"


def at(day):
    return None if day is None else datetime.datetime(2030, 1, day)


def frame(rows, data):
    return rows([(g, i, x, lic, sha, at(day), sum(bool(v and v.strip()) for v in (lic, sha)), 0, "clash", 9, place) for g, i, x, lic, sha, day, place in data], SCHEMA)


def current(df, order=None):
    if order is None:
        order = df.sparkSession.createDataFrame([], "field string, older long, newer long")
    undated = df.join(df.filter("t IS NULL").select("g").distinct(), "g", "left_semi")
    return s.current_values(undated, "g", ["lic", "sha"], order)


def hashed(order):
    return order.select("field", F.xxhash64("older").alias("older"), F.xxhash64("newer").alias("newer"))


def named(order, *values):
    """An order by its values instead of their hashes."""
    known = order.sparkSession.createDataFrame([(v,) for v in values], "v string").select(F.xxhash64("v").alias("h"), "v")
    names = {r.h: r.v for r in known.collect()}
    return {(r.field, names[r.older], names[r.newer]) for r in order.collect()}


def best(df, order=None):
    return {r.g: (r.id, r.best_text) for r in s.survivors(df, "g", "id", "text", "full", "t", ["lic", "sha"], current(df, order)).collect()}


def test_order_of_preference(rows):
    data = [
        (1, 1, "a", None, None, 1, "p"), (1, 2, "bb", "MIT", "x", 2, "p"), (1, 3, "a", "MIT", " ", 1, "p"), (1, 4, "a", "MIT", None, 3, "p"), (1, 5, "a", "MIT", "", 3, "p"),
        (2, 6, "bb", None, None, 1, "p"), (2, 7, "c", None, None, 1, "p"), (2, 8, "b", None, None, 1, "p"),  # the shortest, then the first
        (3, 9, None, "MIT", "x", 1, "p"), (4, 10, None, "MIT", "x", 1, "p"), (4, 11, "", None, None, None, "p"),
    ]
    assert best(frame(rows, data)) == {1: (4, "a"), 2: (8, "b"), 4: (11, "")}
    assert best(frame(rows, [])) == {}


LEARN = [(9, 100 + k, "x", lic, "s", day, f"p{k % 3}") for k, (lic, day) in enumerate([("old", 1), ("old", 1), ("new", 1), ("new", 2), ("new", 2), ("old", 2)])]


def test_learnt_precedence_places_rows_without_time(rows):
    order = s.precedence(frame(rows, LEARN), ["place"], ["lic", "sha"], "t")
    assert named(order, "old", "new") == {("lic", "old", "new")}  # two transitions against one
    data = [(1, 1, "a", "old", "s", None, "q"), (1, 2, "a", "new", "s", None, "q"), (2, 3, "a", "old", "s", None, "q"), (2, 4, "a", "old", "s", None, "q"), (3, 5, "a", "new", "s", None, "q"), (3, 6, "a", "old", "s", 1, "q")]
    df = frame(rows, data)
    assert best(df, order) == {1: (2, "a"), 2: (3, "a"), 3: (6, "a")}  # a time beats none
    got = {r.g: (r.lic, r.sha) for r in s.latest_values(df, "g", "id", ["lic", "sha"], "t", current(df, order)).collect()}
    assert got == {1: ("new", "s"), 2: ("old", "s"), 3: ("old", "s")}


def test_order_is_closed_over_other_values(rows):
    order = rows([("lic", "a", "b"), ("lic", "b", "c"), ("lic", "c", "d"), ("sha", "x", "y"), ("sha", "y", "x")], "field string, older string, newer string")
    got = {tuple(r) for r in s.closed(order).collect()}
    assert got == {("lic", p, q) for p, q in ("ab", "ac", "ad", "bc", "bd", "cd")}
    data = [(1, 1, "t", "a", "s", None, "q"), (1, 2, "t", "d", "s", None, "q"), (1, 3, "t", "b", "s", None, "q")]
    assert best(frame(rows, data), hashed(order)) == {1: (2, "t")}
    assert s.closed(order.limit(0)).count() == 0


def test_order_is_closed_over_long_chains_and_cycles(rows):
    chain = [("sha", f"v{i:02}", f"v{i + 1:02}") for i in range(20)]
    cycle = [("lic", f"c{i:02}", f"c{(i + 1) % 11:02}") for i in range(11)]
    order = rows(chain + cycle, "field string, older string, newer string")
    assert {tuple(r) for r in s.closed(order).collect()} == {("sha", f"v{i:02}", f"v{j:02}") for i in range(21) for j in range(i + 1, 21)}
    data = [(1, 1, "t", "a", "v00", None, "q"), (1, 2, "t", "a", "v20", None, "q")]
    assert best(frame(rows, data), hashed(order)) == {1: (2, "t")}


def test_queries_place_untimed_rows_by_all_fields(spark, tmp_path):
    from twinline.llm import registry

    schema = "step_id long, repo_slug string, file_path string, line int, text string, scenario string, feature string, repo string, license_spdx string, commit_sha string, mined_at timestamp"
    timed = [(10 + i, "r", "f", 1, "x", f"s{i:02}", "u", f"o{i:02}", "MIT", f"v{i:02}", at(1 + i)) for i in range(12)]
    untimed = [(i, "r", "f", 2, "t", f"s{x:02}", "u", f"o{x:02}", "MIT", "v00", None) for i, x in ((1, 0), (2, 11), (3, 0))]
    spark.createDataFrame(timed + untimed, schema).write.parquet(str(tmp_path / "steps.parquet"))
    spark.createDataFrame([(1, "r", "f", 2)], "cluster_id long, repo_slug string, file_path string, line int").write.parquet(str(tmp_path / "cluster_members_hybrid.parquet"))
    spark.createDataFrame([(1, None)], "cluster_id long, canonical_text string").write.parquet(str(tmp_path / "clusters_hybrid.parquet"))
    assert [tuple(r) for r in registry.p5_found(spark, str(tmp_path)).collect()] == [(1, 2)]
    assert [tuple(r) for r in registry.p5_records(spark, str(tmp_path)).collect()] == [(1, 2, "t", "s11", "u", "o11", "MIT", "v00")]


def test_values_field_by_field(rows):
    data = [(1, 1, "a", "MIT", None, 1, "p"), (1, 2, "b", " ", "x", 2, "p"), (1, 3, "c", None, "y", 3, "p"), (2, 4, "a", None, "", 1, "p")]
    df = frame(rows, data)
    got = {r.g: (r.lic, r.sha) for r in s.latest_values(df, "g", "id", ["lic", "sha"], "t", current(df)).collect()}
    assert got == {1: ("MIT", "y"), 2: (None, None)}


def test_equal_times_teach_nothing(rows):
    data = [(1, 1, "a", "x", "s", 1, "p"), (1, 2, "a", "y", "s", 1, "p"), (1, 3, "a", None, "s", 2, "p"), (1, 4, "a", "z", " ", 3, "p"), (1, 5, "a", "w", "s", None, "p")]
    order = s.precedence(frame(rows, data), ["place"], ["lic", "sha"], "t")
    (got,) = named(order, "x", "y", "z")
    assert got[0] == "lic" and got[1] in "xy" and got[2] == "z"
