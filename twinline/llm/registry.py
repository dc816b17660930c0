"""The queries on training data and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinline.llm import copies, encoding, form, language, near, packing, survivors, terms
from twinline.session import cut, new_path, table


PLACE = ["repo_slug", "file_path", "line"]
FIELDS = ["scenario", "feature", "repo", "license_spdx", "commit_sha"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return form.inconsistent(table(spark, d, "steps").select("step_id", "text"), "text").select("step_id")


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    return form.with_form(table(spark, d, "steps").select("step_id", "text"), "text").select("step_id", "form", (F.col("form") == F.col("text")).alias("consistent"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return form.look_alike_groups(table(spark, d, "steps").select("text"), "text")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    counts = terms.TermCounts(spark, new_path(spark, "term-counts"), ["text"], ["repo"])
    counts.update(added=table(spark, d, "steps").select("text", "repo"))
    return counts.terms()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).filter("mark IS NOT NULL").select("field_name", "term", "mark")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


def p3_updated(spark: SparkSession, d: str) -> DataFrame:
    """Counts after three batches: all steps as first mined, then those mined again in place of their older rows, then without steps of unlisted repositories."""
    steps = table(spark, d, "steps").select("step_id", *PLACE, "text", "repo", "mined_at")
    w = Window.partitionBy(*PLACE).orderBy("mined_at", "step_id")
    versions = cut(steps.withColumn("i", F.row_number().over(w)).withColumn("last", F.lead("step_id").over(w).isNull()))
    listed = table(spark, d, "repos").select(F.col("full_name").alias("repo")).distinct()
    batches = [
        (versions.filter("i = 1"), None),
        (versions.filter("i > 1 AND last"), versions.filter("i = 1 AND NOT last")),
        (None, versions.filter("last AND repo IS NOT NULL").join(listed, "repo", "left_anti")),
    ]
    counts = terms.TermCounts(spark, new_path(spark, "term-counts"), ["text"], ["repo"])
    for k, (added, deleted) in enumerate(batches):
        for _ in range(2):  # the second time is skipped
            counts.update(added, deleted, "steps", k)
    return counts.terms()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_pairs(table(spark, d, "steps"), F.col("step_id"), F.col("text"))


def p4_phrases(spark: SparkSession, d: str) -> DataFrame:
    return copies.phrases(table(spark, d, "steps"), F.col("step_id"), F.col("text"))


def _cluster_rows(steps: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The steps rows of each cluster with their completeness, and the current values of clusters with rows that have no time."""
    order = survivors.precedence(steps, PLACE, FIELDS, "mined_at")
    places = members.select("cluster_id", *PLACE).distinct()
    rows = steps.select("step_id", *PLACE, "text", *FIELDS, "mined_at", survivors.completeness(FIELDS).alias("full")).join(places, PLACE)
    undated = steps.join(survivors.undated_members(steps, places, "cluster_id", PLACE, "mined_at"), PLACE)
    return rows, survivors.current_values(undated, "cluster_id", FIELDS, order)


def _survivors(steps: DataFrame, members: DataFrame) -> DataFrame:
    rows, current = _cluster_rows(steps, members)
    return survivors.survivors(rows, "cluster_id", "step_id", "text", "full", "mined_at", FIELDS, current)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    best = _survivors(table(spark, d, "steps"), table(spark, d, "cluster_members_hybrid"))
    stored = table(spark, d, "clusters_hybrid").select("cluster_id", "canonical_text")
    return stored.join(best, "cluster_id").filter(~F.col("canonical_text").eqNullSafe(F.col("best_text"))).select("cluster_id", "step_id")


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster's survivor and best text, with every other field at its latest value."""
    rows, current = _cluster_rows(table(spark, d, "steps"), table(spark, d, "cluster_members_hybrid"))
    best = survivors.survivors(rows, "cluster_id", "step_id", "text", "full", "mined_at", FIELDS, current)
    return best.join(survivors.latest_values(rows, "cluster_id", "step_id", FIELDS, "mined_at", current), "cluster_id")


def p5_undated(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster's survivor where every third row has lost its time and is placed by what the others teach."""
    steps = table(spark, d, "steps").withColumn("mined_at", F.when(F.col("step_id") % 3 != 0, F.col("mined_at")))
    return _survivors(steps, table(spark, d, "cluster_members_hybrid"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "steps").select("step_id", "text").filter(F.length("text") >= 100)
    pairs = near.id_pairs(steps, F.col("step_id"), F.col("text")).select(F.lit("steps").alias("tbl"), "id_a", "id_b")
    labelled = table(spark, d, "labeled_pairs_overlap").select("id", near.word_set(F.col("text_a")).alias("a"), near.word_set(F.col("text_b")).alias("b"))
    reach = labelled.filter(near.similar(F.col("a"), F.col("b"))).select(F.lit("labeled_pairs_overlap").alias("tbl"), F.col("id").alias("id_a"), F.col("id").alias("id_b"))
    return pairs.unionByName(reach)


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "steps").select("step_id", "text").filter(F.length("text") >= 100)
    return near.groups(steps, F.col("step_id"), F.col("text")).withColumnRenamed("id", "step_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the length and hash of the text that comes back from its ids."""
    back = encoding.decode_column(p7_ids(spark, d), "doc_id", "ids")
    return back.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    counted = cut(packing.sizes(table(spark, d, "documents"), "doc_id", "text"))  # three numbers a document
    return packing.pack(counted, "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, and how many there must be at least by each of the limits."""
    used = p8_packing(spark, d).filter("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"), F.sum(packing.counted_loss()).alias("l"))
    needed = F.greatest(F.ceil(F.sum("n") / packing.CAPACITY), F.ceil(F.sum("k") / packing.MOST_SEGMENTS), F.ceil(F.sum("l") / packing.MOST_LOSS))
    return used.agg(
        F.count("*").alias("n_containers"), needed.alias("n_needed"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"), F.max("k").alias("most_segments"), F.max("l").alias("most_loss"),
        F.count_if(F.col("k") == packing.MOST_SEGMENTS).alias("n_full_of_segments"), F.count_if(F.col("l") >= packing.MOST_LOSS * 0.95).alias("n_full_of_loss"),
        (F.sum("n") / (F.count("*") * packing.CAPACITY)).alias("fill"),
    )


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents, tokens lost or doubled, short documents that were split, and containers beyond each limit."""
    items = cut(packing.sizes(table(spark, d, "documents"), "doc_id", "text"))
    packed = cut(packing.pack(items, "doc_id"))
    parts = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"), F.sum(F.col("part_no") * packing.CAPACITY - F.col("start_token")).alias("shift"))
    each = table(spark, d, "documents").select("doc_id", F.length("text").alias("l")).join(items, "doc_id").join(parts, "doc_id", "left").agg(
        F.count("*").alias("n_documents"), F.count_if((F.col("l") > 0) & (F.coalesce("n", F.lit(0)) == 0)).alias("n_missing"), F.count_if(~F.col("n").eqNullSafe(F.col("n_tokens"))).alias("n_other_size"),
        F.count_if((F.col("k") > 1) & (F.col("n_tokens") <= packing.CAPACITY)).alias("n_split_short"), F.count_if(F.col("shift") != 0).alias("n_shifted"),
    )
    used = packed.filter("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"), F.sum(packing.counted_loss()).alias("l"))
    over = used.agg(*(F.count_if(F.col(c) > m).alias(name) for c, m, name in (("n", packing.CAPACITY, "n_over_tokens"), ("k", packing.MOST_SEGMENTS, "n_over_segments"), ("l", packing.MOST_LOSS, "n_over_loss"))))
    return each.crossJoin(over)  # a row each


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    trees = language.fit(table(spark, d, "lang_samples"), "lang", "text", "sample_id")
    return language.detect(table(spark, d, "documents"), "doc_id", "text", trees)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    trees = language.fit(table(spark, d, "lang_samples"), "lang", "text", "sample_id")
    return language.mislabelled(table(spark, d, "documents"), "doc_id", "text", "lang", trees)


_P5 = """
    WITH m AS (SELECT DISTINCT cluster_id, repo_slug, file_path, line FROM cluster_members_hybrid),
    r AS (SELECT m.cluster_id, s.*, (CASE WHEN regexp_matches(scenario, '\\S') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(feature, '\\S') THEN 1 ELSE 0 END
            + CASE WHEN regexp_matches(repo, '\\S') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(license_spdx, '\\S') THEN 1 ELSE 0 END
            + CASE WHEN regexp_matches(commit_sha, '\\S') THEN 1 ELSE 0 END) AS filled
          FROM m JOIN steps s USING (repo_slug, file_path, line) WHERE text IS NOT NULL),
    t AS (SELECT cluster_id, text, count(*) AS n FROM r GROUP BY ALL),
    b AS (SELECT cluster_id, text FROM t QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, length(text), encode(text)) = 1)
    SELECT cluster_id, step_id, r.text AS best_text FROM r JOIN b USING (cluster_id, text)
    QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY filled DESC, mined_at DESC NULLS LAST, step_id) = 1"""

_LATEST = ", ".join(f"arg_max({f}, (mined_at, -step_id)) FILTER (regexp_matches({f}, '\\S')) AS {f}" for f in FIELDS)
_P5_RECORDS = f"""
    WITH m AS (SELECT DISTINCT cluster_id, repo_slug, file_path, line FROM cluster_members_hybrid),
    v AS (SELECT m.cluster_id, {_LATEST} FROM m JOIN steps s USING (repo_slug, file_path, line) GROUP BY 1)
    SELECT b.cluster_id, b.step_id, b.best_text, v.* EXCLUDE (cluster_id) FROM ({_P5}) b JOIN v USING (cluster_id)"""

_LIST = ", ".join(FIELDS)
_NAMES = ", ".join(f"'{f}'" for f in FIELDS)
_P5_UNDATED = f"""
    WITH RECURSIVE s AS (SELECT * REPLACE (CASE WHEN step_id % 3 <> 0 THEN mined_at END AS mined_at) FROM steps),
    l AS (SELECT *, unnest([{_NAMES}]) AS field, unnest([{_LIST}]) AS value FROM s WHERE mined_at IS NOT NULL),
    g AS (SELECT field, value AS newer, mined_at, lag(value) OVER w AS older, lag(mined_at) OVER w AS before FROM l WHERE regexp_matches(value, '\\S')
          WINDOW w AS (PARTITION BY field, repo_slug, file_path, line ORDER BY mined_at, {", ".join(f"{f} NULLS FIRST" for f in FIELDS)})),
    b AS (SELECT field, least(older, newer) AS p, greatest(older, newer) AS q, sum(CASE WHEN older < newer THEN 1 ELSE -1 END) AS balance FROM g WHERE older <> newer AND before < mined_at GROUP BY ALL),
    e AS (SELECT field, CASE WHEN balance > 0 THEN p ELSE q END AS older, CASE WHEN balance > 0 THEN q ELSE p END AS newer FROM b WHERE balance <> 0),
    c AS (SELECT * FROM e UNION SELECT c.field, c.older, e.newer FROM c JOIN e ON c.field = e.field AND c.newer = e.older),
    o AS (SELECT * FROM c WHERE older <> newer AND (field, newer, older) NOT IN (SELECT (field, older, newer) FROM c)),
    m AS (SELECT DISTINCT cluster_id, repo_slug, file_path, line FROM cluster_members_hybrid),
    r AS (SELECT m.cluster_id, s.* FROM m JOIN s USING (repo_slug, file_path, line)),
    x AS (SELECT cluster_id, step_id, mined_at, unnest([{_NAMES}]) AS field, unnest([{_LIST}]) AS value FROM r),
    v AS (SELECT DISTINCT cluster_id, field, value FROM x WHERE regexp_matches(value, '\\S')),
    k AS (SELECT * FROM v WHERE (cluster_id, field, value) NOT IN (SELECT (v.cluster_id, v.field, v.value) FROM v JOIN o ON o.field = v.field AND o.older = v.value JOIN v f ON f.cluster_id = v.cluster_id AND f.field = v.field AND f.value = o.newer)),
    n AS (SELECT cluster_id, step_id, count(*) AS n_current FROM x JOIN k USING (cluster_id, field, value) WHERE mined_at IS NULL GROUP BY ALL),
    h AS (SELECT cluster_id, step_id, count(*) FILTER (regexp_matches(value, '\\S')) AS filled FROM x GROUP BY ALL),
    t AS (SELECT cluster_id, text, count(*) AS n FROM r WHERE text IS NOT NULL GROUP BY ALL),
    a AS (SELECT cluster_id, text FROM t QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, length(text), encode(text)) = 1)
    SELECT cluster_id, step_id, r.text AS best_text FROM r JOIN a USING (cluster_id, text) JOIN h USING (cluster_id, step_id) LEFT JOIN n USING (cluster_id, step_id)
    QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY filled DESC, r.mined_at DESC NULLS LAST, coalesce(n_current, 0) DESC, step_id) = 1"""

_SETS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{Nd}}]+'))"
_REACH = "len({0}) + len({1}) > 0 AND len(list_intersect({0}, {1})) * 9 >= (len({0}) + len({1})) * 4"
_P6 = f"""
    WITH w AS (SELECT step_id, {_SETS.format("text")} AS s FROM steps WHERE length(text) >= 100)
    SELECT 'steps' AS tbl, a.step_id AS id_a, b.step_id AS id_b FROM w a JOIN w b ON a.step_id < b.step_id
    WHERE len(a.s) * 5 >= len(b.s) * 4 AND len(b.s) * 5 >= len(a.s) * 4 AND {_REACH.format("a.s", "b.s")}
    UNION ALL SELECT 'labeled_pairs_overlap', id, id FROM (SELECT id, {_SETS.format("text_a")} AS x, {_SETS.format("text_b")} AS y FROM labeled_pairs_overlap) WHERE {_REACH.format("x", "y")}"""

_P6_GROUPS = f"""
    WITH RECURSIVE p AS (SELECT id_a, id_b FROM ({_P6}) WHERE tbl = 'steps'), w AS (SELECT step_id, list_sort({_SETS.format("text")}) AS s, text FROM steps WHERE length(text) >= 100),
    c AS (SELECT step_id, min(step_id) OVER (PARTITION BY s, CASE WHEN len(s) = 0 THEN text END) AS class_id FROM w), e AS (SELECT id_a, id_b FROM p UNION SELECT id_b, id_a FROM p),
    r AS (SELECT step_id AS node, step_id AS root FROM c UNION SELECT e.id_b, r.root FROM r JOIN e ON e.id_a = r.node)
    SELECT step_id, class_id, group_id FROM c JOIN (SELECT node AS step_id, min(root) AS group_id FROM r GROUP BY 1) USING (step_id)"""

_TERMS = """
    WITH t AS (SELECT 'text' AS field_name, step_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z0-9_]+')) AS term FROM {0}
               UNION ALL SELECT 'repo', step_id, repo FROM {0} WHERE repo IS NOT NULL),
    n AS (SELECT 'text' AS field_name, count(text) AS all_rows FROM {0} UNION ALL SELECT 'repo', count(repo) FROM {0}),
    c AS (SELECT field_name, term, count(*) AS n_occurrences, count(DISTINCT step_id) AS n_rows FROM t GROUP BY ALL)
    SELECT field_name, term, n_occurrences, n_rows, CASE WHEN n_rows < 3 THEN 'too_rare' WHEN n_rows * 10 > all_rows THEN 'too_common' END AS mark FROM c JOIN n USING (field_name)"""
_P3 = _TERMS.format("steps")
_LAST = "(SELECT * FROM (SELECT * FROM steps QUALIFY lead(step_id) OVER (PARTITION BY repo_slug, file_path, line ORDER BY mined_at NULLS FIRST, step_id) IS NULL) WHERE repo IS NULL OR repo IN (SELECT full_name FROM repos))"
_P3_UPDATED = _TERMS.format(_LAST)

QUERIES = {
    "p2_found": p2_found, "p2_forms": p2_forms, "p2_groups": p2_groups, "p3_found": p3_found, "p3_terms": p3_terms, "p3_updated": p3_updated,
    "p4_found": p4_found, "p4_phrases": p4_phrases, "p5_found": p5_found, "p5_records": p5_records, "p5_undated": p5_undated, "p6_found": p6_found, "p6_groups": p6_groups,
    "p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_packing": p8_packing, "p8_fill": p8_fill, "p8_limits": p8_limits, "p9_found": p9_found, "p9_languages": p9_languages,
}
SQL = {
    "p7_decoded": "SELECT doc_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents",
    "p8_limits": "SELECT count(*) AS n_documents, 0 AS n_missing, 0 AS n_other_size, 0 AS n_split_short, 0 AS n_shifted, 0 AS n_over_tokens, 0 AS n_over_segments, 0 AS n_over_loss FROM documents",
    "p3_terms": _P3, "p3_updated": _P3_UPDATED, "p3_found": f"SELECT field_name, term, mark FROM ({_P3}) WHERE mark IS NOT NULL",
    "p5_found": f"SELECT cluster_id, step_id FROM ({_P5}) JOIN clusters_hybrid USING (cluster_id) WHERE canonical_text IS DISTINCT FROM best_text",
    "p5_records": _P5_RECORDS, "p5_undated": _P5_UNDATED, "p6_found": _P6, "p6_groups": _P6_GROUPS,
}
