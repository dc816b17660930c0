"""Queries over the reference tables, one or more for each operator, each over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline import api
from twinline.functions import rules, text
from twinline.functions.edit import indel_ratio
from twinline.functions.vectors import dot
from twinline.operators import cluster, pairs, profile, sampling, stats
from twinline.operators.graph import connected_components
from twinline.operators.ids import numbered
from twinline.session import table
from twinline.sources.files import last_per_key

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The embeddings table is near random: this threshold gives a few hundred pairs, the usual ones none.
COS_EMBEDDINGS = 0.42


def query(sql: str | None = None):
    """Registers a function of (spark, directory) under its name, with the SQL it is compared with."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


W = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(c: str) -> str:
    return f"trim(regexp_replace({c}, '{W}', ' ', 'g'))"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{W}|{W}$', '', 'g')"


def steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "steps")


def file_of(df: DataFrame | None = None) -> Column:
    """A file's name in a corpus: the repository comes first."""
    return F.concat_ws("/", "repo_slug", "file_path")


@query(f"SELECT step_id, CASE WHEN k IN ('Given', 'When', 'Then', 'And', 'But', '*') THEN k WHEN b = '' THEN '*' ELSE b END AS keyword FROM (SELECT step_id, k, {_strip("regexp_replace(k, '[*]+$', '')")} AS b FROM (SELECT step_id, {_strip('keyword')} AS k FROM steps))")
def a4_keyword(spark, d):
    return steps(spark, d).select("step_id", text.keyword_of(F.col("keyword")).alias("keyword"))


@query("SELECT step_id, repo_slug, line FROM steps WHERE is_outline AND line > 20")
def a9_pruned_scan(spark, d):
    return steps(spark, d).filter("is_outline AND line > 20").select("step_id", "repo_slug", "line")


@query("SELECT replace(full_name, '/', '_') AS repo_slug, arg_max(full_name, (coalesce(last_pushed, ''), coalesce(stargazers_count, -1))) AS full_name, max(stargazers_count) AS stars FROM repos WHERE full_name IS NOT NULL GROUP BY 1")
def a10_repos_by_slug(spark, d):
    rows = table(spark, d, "repos").filter("full_name IS NOT NULL").withColumn("repo_slug", text.slug_of(F.col("full_name")))
    last = last_per_key(rows, "repo_slug", [F.coalesce("last_pushed", F.lit("")), F.coalesce("stargazers_count", F.lit(-1))]).select("repo_slug", "full_name")
    return last.join(rows.groupBy("repo_slug").agg(F.max("stargazers_count").alias("stars")), "repo_slug")


@query("SELECT s.repo_slug, min(coalesce(m.commit_sha, '')) AS commit_sha FROM (SELECT DISTINCT repo_slug FROM steps) s LEFT JOIN clone_manifest m ON replace(m.full_name, '/', '_') = s.repo_slug GROUP BY 1")
def a17_commit(spark, d):
    m = table(spark, d, "clone_manifest").select(text.slug_of(F.col("full_name")).alias("repo_slug"), "commit_sha")
    return steps(spark, d).select("repo_slug").distinct().join(m, "repo_slug", "left").groupBy("repo_slug").agg(F.min(F.coalesce("commit_sha", F.lit(""))).alias("commit_sha"))


def _one_repo(spark, d) -> DataFrame:
    """One row per slug; repos lists some twice, with other stars."""
    rows = table(spark, d, "repos").filter("full_name IS NOT NULL").withColumn("repo_slug", text.slug_of(F.col("full_name")))
    return rows.groupBy("repo_slug").agg(F.max("stargazers_count").alias("stars"), F.min("license_spdx").alias("spdx"), F.min("license_class").alias("class"))


_REPO = "(SELECT replace(full_name, '/', '_') AS repo_slug, max(stargazers_count) AS stars, min(license_spdx) AS spdx, min(license_class) AS class FROM repos WHERE full_name IS NOT NULL GROUP BY 1)"


@query(f"SELECT step_id, s.repo_slug, stars, spdx FROM steps s LEFT JOIN {_REPO} r USING (repo_slug)")
def j1_enriched_steps(spark, d):
    return steps(spark, d).join(_one_repo(spark, d), "repo_slug", "left").select("step_id", "repo_slug", "stars", "spdx")


@query(f"SELECT r.repo_slug, coalesce(spdx, '') AS spdx, coalesce(class, 'unknown') AS class, coalesce(m.commit_sha, '') AS commit_sha, coalesce(m.status, 'unknown') AS status FROM {_REPO} r LEFT JOIN clone_manifest m ON replace(m.full_name, '/', '_') = r.repo_slug")
def j2_repo_manifest(spark, d):
    m = table(spark, d, "clone_manifest").select(text.slug_of(F.col("full_name")).alias("repo_slug"), "commit_sha", "status")
    joined = _one_repo(spark, d).join(m, "repo_slug", "left")
    return joined.select("repo_slug", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in (("spdx", ""), ("class", "unknown"), ("commit_sha", ""), ("status", "unknown"))))


@query("SELECT repo_slug, coalesce(arg_min(license_class, step_id) FILTER (license_class IS NOT NULL), 'unknown') AS license_class FROM steps GROUP BY 1")
def j3_license_lookup(spark, d):
    first = F.min_by(F.when(F.col("license_class").isNotNull(), F.col("license_class")), F.when(F.col("license_class").isNotNull(), F.col("step_id")))
    return steps(spark, d).groupBy("repo_slug").agg(F.coalesce(first, F.lit("unknown")).alias("license_class"))


@query()
def j4_near_exact_pairs(spark, d):
    texts = sampling.distinct_texts(steps(spark, d))
    return pairs.edit_pairs(texts, "text", "text", api.LEV)


_COS = f"SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS cos FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= {COS_EMBEDDINGS}"


@query(f"SELECT a, b, round(cos, 6) AS cos FROM ({_COS})")
def j5_cosine_pairs(spark, d):
    return pairs.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", COS_EMBEDDINGS).withColumn("cos", F.round("cos", 6))


@query("SELECT repo, count(*) AS n FROM steps WHERE repo IS NOT NULL AND repo NOT IN (SELECT full_name FROM repos WHERE full_name IS NOT NULL) GROUP BY 1")
def j9_unlisted_repos(spark, d):
    known = table(spark, d, "repos").select(F.col("full_name").alias("repo"))
    return steps(spark, d).groupBy("repo").agg(F.count("*").alias("n")).filter("repo IS NOT NULL").join(known, "repo", "left_anti")


@query("SELECT id, text_a, text_b, band FROM labeled_pairs_overlap WHERE text_a IS NOT NULL AND text_b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY least(text_a, text_b), greatest(text_a, text_b) ORDER BY band DESC NULLS LAST, id) = 1")
def j10_distinct_pairs(spark, d):
    rows = table(spark, d, "labeled_pairs_overlap").select("id", "text_a", "text_b", "band").filter("text_a IS NOT NULL AND text_b IS NOT NULL")
    return pairs.distinct_pairs(rows, "text_a", "text_b", F.struct("band", -F.col("id")))


_EXACT = f"SELECT {_norm('text')} AS canonical_text, count(*) AS count, count(DISTINCT concat_ws('/', repo_slug, file_path)) AS occurrence_files FROM steps WHERE {_norm('text')} <> '' GROUP BY 1 HAVING count(*) >= 2"


@query(_EXACT)
def g1_cluster_exact(spark, d):
    return cluster.exact(steps(spark, d), file=file_of())


@query(f"""WITH RECURSIVE p AS ({_COS}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
    SELECT node, min(root) AS component FROM r GROUP BY 1""")
def g3_components(spark, d):
    return connected_components(pairs.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", COS_EMBEDDINGS), "a", "b")


@query()
def g4_cluster_near_exact(spark, d):
    return cluster.clusters(steps(spark, d), "near-exact", file=file_of(), lev=api.LEV)


@query()
def g5_cluster_semantic(spark, d):
    return cluster.clusters(steps(spark, d), "semantic", file=file_of(), cos=api.COS)


@query()
def g5_cluster_hybrid(spark, d):
    return cluster.clusters(steps(spark, d), "hybrid", file=file_of(), cos=api.COS)


@query(f"""WITH t AS (SELECT cluster_id, {_norm('text')} AS norm, count(*) AS n FROM cluster_members_hybrid WHERE {_norm('text')} <> '' GROUP BY ALL)
    SELECT cluster_id AS component, arg_min(norm, (-n, length(norm), norm)) AS canonical_text, CAST(sum(n) AS BIGINT) AS count FROM t GROUP BY 1""")
def g6_merge(spark, d):
    rows = cluster.with_norm(table(spark, d, "cluster_members_hybrid"))
    return cluster.merge(rows.groupBy("norm", F.col("cluster_id").alias("component")).agg(F.count("*").alias("n")))


@query(f"""WITH r AS (SELECT {_norm('text')} AS canonical_text, text, repo_slug, coalesce(license_class, 'unknown') AS license_class, file_path, line FROM steps WHERE {_norm('text')} <> ''),
    v AS (SELECT canonical_text, count(*) AS count, count(DISTINCT text) AS n_distinct_variants, count(DISTINCT repo_slug) AS n_distinct_repos, avg(CASE WHEN license_class = 'permissive' THEN 1.0 ELSE 0.0 END) AS permissive_fraction,
          coalesce(list_sort(list(DISTINCT text) FILTER (text <> canonical_text)), [])[1:5] AS member_examples FROM r GROUP BY 1),
    c AS (SELECT canonical_text, license_class, count(*) AS n, min((repo_slug, file_path, line)) AS place FROM r GROUP BY ALL),
    t AS (SELECT canonical_text, license_class AS top_license_class FROM c QUALIFY row_number() OVER (PARTITION BY canonical_text ORDER BY n DESC, place, license_class) = 1)
    SELECT canonical_text, count, n_distinct_variants, n_distinct_repos, permissive_fraction, member_examples, top_license_class FROM v JOIN t USING (canonical_text) WHERE count >= 2""")
def g9_cluster_profile(spark, d):
    rows = cluster.with_norm(steps(spark, d)).select("norm", F.col("norm").alias("canonical_text"), "text", "repo_slug", "file_path", "line", "license_class")
    return profile.cluster_profile(rows, "norm", "canonical_text", F.struct("repo_slug", "file_path", "line")).filter("count >= 2").withColumnRenamed("norm", "canonical_text")


@query(f"SELECT count(*) AS n_steps, count(DISTINCT {_strip('text')}) AS n_unique_step_texts, count(*) FILTER (is_background) AS n_background, count(*) FILTER (is_outline) AS n_outline FROM steps")
def g10_stats(spark, d):
    return api.step_stats(steps(spark, d))


@query("SELECT license_class, count(*) AS n, count(DISTINCT repo_slug) AS n_repos, count(*) FILTER (is_background) AS n_background FROM steps GROUP BY 1")
def g11_license_counts(spark, d):
    by_repo = steps(spark, d).groupBy("license_class", "repo_slug").agg(F.count("*").alias("n"), F.count_if("is_background").alias("b"))
    return by_repo.groupBy("license_class").agg(F.sum("n").alias("n"), F.count("repo_slug").alias("n_repos"), F.sum("b").alias("n_background"))


@query(f"""WITH r AS (SELECT unnest(['overall', license_class]) AS stratum, repo_slug, {_strip('text')} AS t, {_norm('text')} AS norm FROM steps WHERE text IS NOT NULL),
    b AS (SELECT stratum, count(*) AS n_steps, count(DISTINCT t) AS n_unique, 1 - count(DISTINCT t) / count(*) AS dup_rate, count(DISTINCT repo_slug) AS n_repos FROM r WHERE stratum IS NOT NULL GROUP BY 1),
    c AS (SELECT stratum, norm, count(*) AS n FROM r WHERE norm <> '' GROUP BY ALL HAVING count(*) >= 2)
    SELECT b.*, coalesce(k, 0) AS n_clusters, CAST(coalesce(m, 0) AS BIGINT) AS n_clustered FROM b LEFT JOIN (SELECT stratum, count(*) AS k, sum(n) AS m FROM c GROUP BY 1) USING (stratum)""")
def g12_license_strata(spark, d):
    return profile.licence_strata(steps(spark, d))


_RATE = f"SELECT repo_slug, count(*) AS n_steps, count(DISTINCT {_strip('text')}) AS n_unique, 1 - count(DISTINCT {_strip('text')}) / count(*) AS dup_rate FROM steps WHERE text IS NOT NULL GROUP BY 1"


@query(f"SELECT r.*, license_class FROM ({_RATE}) r JOIN (SELECT repo_slug, first(license_class ORDER BY step_id) AS license_class FROM steps GROUP BY 1) USING (repo_slug)")
def g13_repo_duplication(spark, d):
    first = steps(spark, d).groupBy("repo_slug").agg(F.min_by("license_class", "step_id").alias("license_class"))
    return profile.duplication(steps(spark, d), "repo_slug").join(first, "repo_slug")


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 5) AS cos FROM embeddings x, embeddings y")
def j7_similarity_matrix(spark, d):
    return pairs.similarity_matrix(table(spark, d, "embeddings"), "vec_id", "embedding").withColumn("cos", F.round("cos", 5))


@query(f"SELECT row_number() OVER (ORDER BY count DESC, canonical_text) AS rank, count FROM ({_EXACT})")
def g14_rank_distribution(spark, d):
    return numbered(cluster.exact(steps(spark, d), file=file_of()), [F.desc("count"), F.asc("canonical_text")], "rank", 1).select("rank", "count")


@query(f"SELECT median(count) AS median_size FROM ({_EXACT})")
def g14_median_size(spark, d):
    sizes = cluster.exact(steps(spark, d), file=file_of()).groupBy("count").agg(F.count("*").alias("n"))
    return sizes.agg(F.expr("percentile(count, 0.5, n)").alias("median_size"))


@query("SELECT quantile_cont(l, 0.5) AS p50, quantile_cont(l, 0.9) AS p90, quantile_cont(l, 0.95) AS p95, quantile_cont(l, 0.99) AS p99, max(l) AS longest FROM (SELECT length(text) AS l FROM steps)")
def g15_length_percentiles(spark, d):
    return profile.length_profile(steps(spark, d))


@query("SELECT CAST(least(floor(log10(length(text)) * 79 / 3.5), 78) AS INT) AS bin, count(*) AS n FROM steps WHERE length(text) >= 1 AND log10(length(text)) <= 3.5 GROUP BY 1")
def g15_length_histogram(spark, d):
    return profile.length_histogram(steps(spark, d))


@query("SELECT count(*) FILTER (lev = 1 AND consensus = 1) AS tp, count(*) FILTER (lev = 1 AND consensus = 0) AS fp, count(*) FILTER (lev <> 1 AND consensus = 1) AS fn, count(*) FILTER (lev <> 1 AND consensus = 0) AS tn FROM labeled_pairs_overlap")
def g16_exact_quality(spark, d):
    return table(spark, d, "labeled_pairs_overlap").agg(*stats.confusion(F.col("lev") == 1, F.col("consensus") == 1))


@query("SELECT rule, count(*) AS n FROM labeled_pairs_overlap GROUP BY 1")
def g17_rule_counts(spark, d):
    return table(spark, d, "labeled_pairs_overlap").groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT license_class, count(*) AS n FROM repos GROUP BY 1")
def g18_repo_licenses(spark, d):
    return table(spark, d, "repos").groupBy("license_class").agg(F.count("*").alias("n"))


@query("SELECT status, count(*) AS n, CAST(sum(n_feature_files) AS BIGINT) AS files, CAST(sum(disk_kb) AS BIGINT) AS kb FROM clone_manifest GROUP BY 1")
def g19_clone_tally(spark, d):
    return table(spark, d, "clone_manifest").groupBy("status").agg(F.count("*").alias("n"), F.sum("n_feature_files").alias("files"), F.sum("disk_kb").alias("kb"))


@query("SELECT count(DISTINCT (repo_slug, file_path)) AS n_files FROM steps")
def g20_distinct_files(spark, d):
    return steps(spark, d).select("repo_slug", "file_path").distinct().agg(F.count("*").alias("n_files"))


@query("SELECT full_name FROM repos WHERE NOT archived AND stargazers_count >= 100")
def f8_repo_filter(spark, d):
    return table(spark, d, "repos").filter("NOT archived AND stargazers_count >= 100").select("full_name")


@query("SELECT id, CASE WHEN cos >= 0.5 AND cos < 0.7 THEN '[0.50,0.70)' WHEN cos >= 0.7 AND cos < 0.8 THEN '[0.70,0.80)' WHEN cos >= 0.8 AND cos < 0.85 THEN '[0.80,0.85)' WHEN cos >= 0.85 AND cos < 0.9 THEN '[0.85,0.90)' WHEN cos >= 0.9 AND cos < 0.95 THEN '[0.90,0.95)' WHEN cos >= 0.95 AND cos <= 1 THEN '[0.95,1.00]' END AS band FROM labeled_pairs_overlap")
def f9_band(spark, d):
    return table(spark, d, "labeled_pairs_overlap").select("id", pairs.band_of(F.col("cos")).alias("band"))


@query("SELECT DISTINCT repo, commit_sha, file_path FROM steps WHERE trim(repo) <> '' AND trim(commit_sha) <> '' AND trim(file_path) <> ''")
def f10_u4_triples(spark, d):
    keys = ("repo", "commit_sha", "file_path")
    rows = steps(spark, d).select(*keys)
    for k in keys:
        rows = rows.filter(F.trim(k) != "")
    return rows.distinct()


@query(f"SELECT repo_slug, n_steps, (rank() OVER (ORDER BY n_steps) + (count(*) OVER (PARTITION BY n_steps) - 1) / 2.0)::DOUBLE AS rank_n FROM ({_RATE})")
def w1_average_ranks(spark, d):
    return profile.average_ranks(profile.duplication(steps(spark, d), "repo_slug").select("repo_slug", "n_steps"), "n_steps", "rank_n")


@query(f"WITH c AS (SELECT license_class, {_norm('text')} AS norm, count(*) AS n FROM steps WHERE {_norm('text')} <> '' AND license_class IS NOT NULL GROUP BY ALL) SELECT license_class, norm, n, row_number() OVER (PARTITION BY license_class ORDER BY n DESC, norm) AS rank FROM c QUALIFY rank <= 5")
def w2_top_per_class(spark, d):
    rows = cluster.with_norm(steps(spark, d)).filter("license_class IS NOT NULL").groupBy("license_class", "norm").agg(F.count("*").alias("n"))
    return profile.top_per_group(rows, "license_class", [F.desc("n"), F.asc("norm")], 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT count, occurrence_files, CASE WHEN length(canonical_text) > 80 THEN canonical_text[1:77] || '...' ELSE canonical_text END AS text FROM (SELECT * FROM ({_EXACT}) ORDER BY count DESC, canonical_text LIMIT 20)")
def w3_k7_top_clusters(spark, d):
    from twinline.sinks.reports import console

    return console(cluster.exact(steps(spark, d), file=file_of()))


@query()
def w4_sample_per_band(spark, d):
    return sampling.per_stratum(table(spark, d, "labeled_pairs_overlap").select("id", "band"), "band", 10, [F.col("id")])


@query(f"SELECT row_number() OVER (ORDER BY count DESC, canonical_text) - 1 AS cluster_id, canonical_text FROM ({_EXACT})")
def w5_cluster_ids(spark, d):
    return numbered(cluster.exact(steps(spark, d), file=file_of()), [F.desc("count"), F.asc("canonical_text")], "cluster_id").select("cluster_id", "canonical_text")


@query("SELECT repo_slug, arg_min(step_id, (file_path, line, step_id)) AS step_id FROM steps GROUP BY 1")
def w6_first_step(spark, d):
    return steps(spark, d).groupBy("repo_slug").agg(F.min_by("step_id", F.struct("file_path", "line", "step_id")).alias("step_id"))


@query("SELECT full_name FROM repos UNION ALL SELECT full_name FROM clone_manifest")
def u1_union(spark, d):
    return table(spark, d, "repos").select("full_name").unionByName(table(spark, d, "clone_manifest").select("full_name"))


@query("SELECT full_name FROM clone_manifest EXCEPT SELECT repo FROM steps")
def u2_difference(spark, d):
    return table(spark, d, "clone_manifest").select("full_name").subtract(steps(spark, d).select(F.col("repo").alias("full_name")))


@query("SELECT full_name, max(stargazers_count) AS stars FROM repos GROUP BY 1")
def u3_distinct_repos(spark, d):
    return table(spark, d, "repos").groupBy("full_name").agg(F.max("stargazers_count").alias("stars"))


@query(f"SELECT DISTINCT {_norm('text')} AS text FROM steps WHERE {_norm('text')} <> ''")
def u5_distinct_texts(spark, d):
    return sampling.distinct_texts(steps(spark, d))


_BARE = "trim(regexp_replace(regexp_replace(lower(regexp_replace({0}, '\"[^\"]*\"|''[^'']*''|[<>][\\p{{L}}\\p{{M}}\\p{{N}}_-]+[<>]|[0-9]+', ' PARAM ', 'g')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '[\\s]+', ' ', 'g'))"


def _words(c: str) -> str:
    return f"list_distinct(list_filter(string_split({_BARE.format(c)}, ' '), lambda w: w <> ''))"


@query(f"SELECT id, len(list_intersect(a, b)) AS n_both, len(list_distinct(list_concat(a, b))) AS n_any, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS jaccard FROM (SELECT id, {_words('text_a')} AS a, {_words('text_b')} AS b FROM labeled_pairs_overlap)")
def u6_x12_token_sets(spark, d):
    rows = table(spark, d, "labeled_pairs_overlap").select("id", text.bare_words(F.col("text_a")).alias("a"), text.bare_words(F.col("text_b")).alias("b"))
    wa, wb = text.words_of(F.col("a")), text.words_of(F.col("b"))
    return rows.select("id", F.size(F.array_intersect(wa, wb)).alias("n_both"), F.size(F.array_union(wa, wb)).alias("n_any"), text.token_jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@query(f"SELECT step_id, {_norm('text')} AS norm, {_strip('text')} AS stripped FROM steps")
def x1_normalise(spark, d):
    return steps(spark, d).select("step_id", text.normalise(F.col("text")).alias("norm"), text.strip_ends(F.col("text")).alias("stripped"))


@query()
def x2_content_hash(spark, d):
    return steps(spark, d).select("step_id", text.content_hash(F.col("text")).alias("hash"))


@query()
def x3_indel_ratio(spark, d):
    return table(spark, d, "labeled_pairs_overlap").select("id", F.round(indel_ratio(F.col("text_a"), F.col("text_b")), 4).alias("lev"))


@query("SELECT id, CASE WHEN length(text_a) = 0 AND length(text_b) = 0 THEN true WHEN length(text_a) = 0 OR length(text_b) = 0 THEN false ELSE 2.0 * least(length(text_a), length(text_b)) / (length(text_a) + length(text_b)) >= 0.8 END AS fits FROM labeled_pairs_overlap")
def x4_length_compatible(spark, d):
    return table(spark, d, "labeled_pairs_overlap").select("id", text.length_compatible(F.col("text_a"), F.col("text_b"), 0.8).alias("fits"))


@query("SELECT x.vec_id AS vec_id, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cos FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def x5_cosine(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(dot(F.col("embedding"), F.col("other")), 6).alias("cos"))


@query("SELECT step_id, len(regexp_extract_all(text, '\"[^\"\\\\]*\"|''[^''\\\\]*''')) AS n FROM steps")
def x8_quoted_count(spark, d):
    return steps(spark, d).select("step_id", text.quoted_count(F.col("text")).alias("n"))


_CANON = """SELECT cluster_id, arg_min(text, (-n, len(regexp_extract_all(text, '"[^"\\\\]*"|''[^''\\\\]*''')), length(text), text)) AS canonical_text FROM (SELECT cluster_id, text, count(*) AS n FROM cluster_members_hybrid WHERE text IS NOT NULL GROUP BY ALL) GROUP BY 1"""


@query(_CANON)
def x9_canonical_text(spark, d):
    return cluster.canonical_text(table(spark, d, "cluster_members_hybrid"), "cluster_id", "text")


@query(f"SELECT cluster_id, repo_slug, file_path, line, text FROM cluster_members_hybrid m JOIN ({_CANON}) c USING (cluster_id) WHERE text = canonical_text QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY repo_slug, file_path, line) = 1")
def x10_canonical_step(spark, d):
    rows = table(spark, d, "cluster_members_hybrid").select("cluster_id", "repo_slug", "file_path", "line", "text")
    return cluster.canonical_step(rows, "cluster_id", "text", F.struct("repo_slug", "file_path", "line"))


@query(f"SELECT id, {_BARE.format('text_a')} AS words FROM labeled_pairs_overlap")
def x11_bare_words(spark, d):
    return table(spark, d, "labeled_pairs_overlap").select("id", text.bare_words(F.col("text_a")).alias("words"))


_TFIDF = f"""WITH s AS (SELECT id, 0 AS side, text_a AS t FROM labeled_pairs_overlap WHERE text_a IS NOT NULL UNION ALL SELECT id, 1, text_b FROM labeled_pairs_overlap WHERE text_b IS NOT NULL),
    w AS (SELECT id, side, ' ' || unnest(list_filter(regexp_split_to_array(lower(t), '{W}'), lambda x: x <> '')) || ' ' AS w FROM s), k AS (SELECT *, unnest([3, 4, 5]) AS k FROM w),
    i AS (SELECT *, unnest(range(1, greatest(length(w) - k + 1, 1) + 1)) AS i FROM k WHERE k = 3 OR k <= length(w)),
    f AS (SELECT id, side, w[i:i + k - 1] AS g, 1 + ln(count(*)) AS tf FROM i GROUP BY ALL), d AS (SELECT g, ln((1 + (SELECT count(*) FROM s)) / (1 + count(*))) + 1 AS idf FROM f GROUP BY 1),
    v AS (SELECT id, side, g, tf * idf AS x FROM f JOIN d USING (g)), n AS (SELECT id, sqrt(sum(x * x) FILTER (side = 0)) * sqrt(sum(x * x) FILTER (side = 1)) AS n FROM v GROUP BY 1),
    c AS (SELECT a.id, sum(a.x * b.x) AS xy FROM v a JOIN v b ON a.id = b.id AND a.g = b.g AND a.side = 0 AND b.side = 1 GROUP BY 1)
    SELECT l.id, round(coalesce(xy / n, 0), 6) AS cos FROM labeled_pairs_overlap l LEFT JOIN c USING (id) LEFT JOIN n USING (id)"""


@query(_TFIDF)
def x13_tfidf_cosine(spark, d):
    return stats.tfidf_cosine(table(spark, d, "labeled_pairs_overlap"), "id", "text_a", "text_b").withColumn("cos", F.round("cos", 6))


@query("SELECT id, " + "coalesce(" + ", ".join(f"CASE WHEN text_a LIKE '%\"{v}\"%' OR ' ' || {_strip('text_a')} || ' ' LIKE '% {v} %' THEN '{v}' END" for v in rules.VERBS) + ") AS verb FROM labeled_pairs_overlap")
def x15_http_verb(spark, d):
    return table(spark, d, "labeled_pairs_overlap").select("id", rules.http_verb(F.col("text_a")).alias("verb"))


@query("SELECT full_name, CASE WHEN license_spdx IS NULL OR trim(license_spdx) = '' THEN 'unlicensed' WHEN license_spdx IN (" + ", ".join(f"'{x}'" for x in text.PERMISSIVE) + ") THEN 'permissive' WHEN license_spdx IN (" + ", ".join(f"'{x}'" for x in text.COPYLEFT) + ") THEN 'copyleft' ELSE 'unknown' END AS class FROM repos")
def x19_license_class(spark, d):
    return table(spark, d, "repos").select("full_name", text.license_class_of(F.col("license_spdx")).alias("class"))


@query("SELECT step_id, split_part(p, '/', 1) AS slug, p[length(split_part(p, '/', 1)) + 2:] AS rest FROM (SELECT step_id, concat_ws('/', repo_slug, file_path) AS p FROM steps)")
def x20_split_path(spark, d):
    slug, rest = text.split_path(F.concat_ws("/", "repo_slug", "file_path"))
    return steps(spark, d).select("step_id", slug.alias("slug"), rest.alias("rest"))


@query("SELECT step_id, CASE WHEN length(text) > 80 THEN text[1:77] || '...' ELSE text END AS short FROM steps")
def x21_snippet(spark, d):
    return steps(spark, d).select("step_id", text.snippet(F.col("text")).alias("short"))


@query("SELECT full_name, last_pushed[1:10] AS day FROM repos")
def x23_day(spark, d):
    return table(spark, d, "repos").select("full_name", text.day_of(F.col("last_pushed")).alias("day"))


NEGATING = ("not", "should", "shouldn't")


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _verb_sql(c: str, strip: bool = True) -> str:
    padded = f"' ' || {_strip(c) if strip else c} || ' '"
    return "coalesce(" + ", ".join(f"CASE WHEN contains({c}, '\"{v}\"') OR contains({padded}, ' {v} ') THEN '{v}' END" for v in rules.VERBS) + ")"


def _some(test: str, x: str, words) -> str:
    return "(" + " OR ".join(f"{test}({x}, '{w}')" for w in words) + ")"


def _both(f, a: str, b: str) -> str:
    return f"({f(a, b)} OR {f(b, a)})"


def _lower_tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '{W}'), lambda w: w <> ''))"


def _only(a: str, b: str, words) -> str:
    x, y = _lower_tokens(a), _lower_tokens(b)
    return f"len(list_filter(list_concat(list_filter({x}, lambda w: NOT list_contains({y}, w)), list_filter({y}, lambda w: NOT list_contains({x}, w))), lambda w: w NOT IN ({_in(words)}))) = 0"


def _cues_sql(a: str = "text_a", b: str = "text_b") -> dict[str, str]:
    def word(x: str, w: str) -> str:
        return f"regexp_matches({x}, '(^|\\W){w}(\\W|$)')"

    def no(x: str, w: str) -> str:
        return f"regexp_matches({x}, '{'\\bcan not\\b|\\bcannot\\b' if w == 'can' else rf'\b{w} not\b'}')"

    la, lb, content = f"lower({a})", f"lower({b})", (*rules.CONTENT, "== ")
    act = lambda x: f"{_some('starts_with', x, rules.ACTION_STARTS)} AND NOT {_some('starts_with', x, rules.ASSERTION_STARTS)}"
    flips = lambda x, y: " OR ".join(f"({no(x, w)} AND regexp_matches({y}, '\\b{w}\\b') AND NOT {no(y, w)})" for w in rules.NEGATED)
    return {
        "call": _both(lambda x, y: f"({word(x, 'call')} AND NOT {word(x, 'callonce')} AND {word(y, 'callonce')})", a, b),
        "def_set": _both(lambda x, y: f"(starts_with({_strip(x)}, 'def ') AND starts_with({_strip(y)}, 'set '))", a, b),
        "polarity": f"({_both(flips, a, b)} OR {_only(a, b, NEGATING)})",
        "presence": _both(lambda x, y: f"({_some('contains', x, rules.EXISTENCE)} AND {_some('contains', y, content)} AND NOT {_some('contains', x, content)})", la, lb),
        "action": _both(lambda x, y: f"({act(x)} AND contains({y}, 'should') AND NOT contains({x}, 'should'))", _strip(la), _strip(lb)),
    }


_CUES = ", ".join(f"{v} AS {k}" for k, v in _cues_sql().items())
_RUBRIC = f"""WITH c AS (SELECT id, cos, lev, {_CUES}, {_verb_sql('text_a')} AS va, {_verb_sql('text_b')} AS vb, least(length(text_a), length(text_b)) / greatest(length(text_a), length(text_b), 1) AS size FROM labeled_pairs_overlap),
    r AS (SELECT id, CASE WHEN call THEN 'R4_call_vs_callonce' WHEN def_set THEN 'R4_def_vs_set' WHEN va <> vb THEN 'R5_different_http_verbs' WHEN polarity THEN 'R6_polarity_flip' WHEN presence THEN 'R7_presence_vs_content' WHEN action THEN 'R8_action_vs_assertion'
      WHEN cos >= 0.92 AND lev >= 0.80 THEN 'R1_parametric_high_cos_high_lev' WHEN cos >= 0.88 AND lev >= 0.70 AND size >= 0.75 THEN 'R1_parametric_high_cos_mid_lev' WHEN cos >= 0.85 AND lev >= 0.85 THEN 'R1_parametric_mid_cos_high_lev'
      WHEN cos >= 0.82 AND lev >= 0.65 AND size >= 0.80 THEN 'R2_paraphrase_similar_length' ELSE 'R10_default_not_duplicate' END AS rule FROM c)
    SELECT id, CASE WHEN rule LIKE 'R1\\_%' ESCAPE '\\' OR rule LIKE 'R2%' THEN 1 ELSE 0 END AS label, rule FROM r"""


def _canon_sql(c: str) -> str:
    cases = " ".join(f"WHEN w IN ({_in(f)}) THEN '{min(f)}'" for f in rules.SYNONYMS)
    return f"list_transform(list_filter(string_split({_BARE.format(c)}, ' '), lambda w: w <> ''), lambda w: CASE {cases} ELSE w END)"


def _score_free_sql() -> str:
    la, lb = "lower(text_a)", "lower(text_b)"
    cues = _cues_sql(la, lb)
    deny = lambda x: f"(list_contains({_lower_tokens(x)}, 'not') OR list_contains({_lower_tokens(x)}, 'n''t'))"
    says = lambda x: f"(starts_with({x}, 'should ') OR contains({x}, ' should ') OR starts_with({x}, 'the '))"
    exist = _both(lambda x, y: f"({_some('contains', x, rules.EXISTENCE)} AND {_some('contains', y, rules.CONTENT)})", la, lb)
    act = _both(lambda x, y: f"({_some('starts_with', x, rules.ACTION_STARTS)} AND {says(y)} AND NOT {says(x)})", la, lb)
    return f"""WITH t AS (SELECT *, {_canon_sql('text_a')} AS ca, {_canon_sql('text_b')} AS cb FROM labeled_pairs_overlap),
    s AS (SELECT *, list_distinct(ca) AS sa, list_distinct(cb) AS sb, array_to_string(ca, ' ') AS ja, array_to_string(cb, ' ') AS jb FROM t),
    r AS (SELECT id, CASE WHEN {cues['call']} OR {_cues_sql()['def_set']} THEN 'R4_sf' WHEN {_verb_sql('text_a', False)} <> {_verb_sql('text_b', False)} THEN 'R5_sf'
      WHEN {deny('text_a')} <> {deny('text_b')} AND {_only('text_a', 'text_b', ('not', "n't", 'should', "shouldn't"))} THEN 'R6_sf' WHEN {exist} THEN 'R7_sf' WHEN {act} THEN 'R8_sf'
      WHEN ca = cb THEN 'P1_sf_exact_after_normalisation' WHEN list_sort(ca) = list_sort(cb) AND len(ca) >= 3 THEN 'P2_sf_token_multiset'
      WHEN least(len(ca), len(cb)) >= 3 AND (CASE WHEN len(ca) <= len(cb) THEN contains(jb, ja) ELSE contains(ja, jb) END) AND least(len(ca), len(cb)) / greatest(len(ca), len(cb)) >= 0.7 THEN 'P3_sf_subsequence'
      WHEN len(sa) > 0 AND len(sb) > 0 AND len(list_intersect(sa, sb)) / len(list_distinct(list_concat(sa, sb))) >= 0.8 THEN 'P4_sf_token_jaccard' ELSE 'R10_sf_default' END AS rule FROM s)
    SELECT id, CASE WHEN rule LIKE 'P%' THEN 1 ELSE 0 END AS label, rule FROM r"""


def _labelled(spark, d) -> DataFrame:
    return table(spark, d, "labeled_pairs_overlap")


@query(f"SELECT id, {_canon_sql('text_a')} AS tokens FROM labeled_pairs_overlap")
def x14_canonical_tokens(spark, d):
    return table(spark, d, "labeled_pairs_overlap").select("id", rules.canonical_tokens(F.col("text_a")).alias("tokens"))


@query(f"SELECT id, {_CUES} FROM labeled_pairs_overlap")
def x16_x18_cues(spark, d):
    a, b = F.col("text_a"), F.col("text_b")
    cues = {"call": rules.call_against_callonce, "def_set": rules.def_against_set, "polarity": rules.polarity_flip, "presence": rules.presence_against_content, "action": rules.action_against_assertion}
    return table(spark, d, "labeled_pairs_overlap").select("id", *(f(a, b).alias(n) for n, f in cues.items()))


@query(_RUBRIC)
def s1_rubric_label(spark, d):
    return _labelled(spark, d).select("id", rules.rubric_label(*(F.col(c) for c in ("text_a", "text_b", "cos", "lev"))).alias("x")).select("id", "x.*")


@query(_score_free_sql())
def s2_score_free_label(spark, d):
    return _labelled(spark, d).select("id", rules.score_free_label(F.col("text_a"), F.col("text_b")).alias("x")).select("id", "x.*")


_SCORES = "SELECT unnest(['semantic', 'near-exact', 'hybrid']) AS strategy, unnest([cos, lev, CASE WHEN lev BETWEEN 0.3 AND 0.95 THEN cos END]) AS score, consensus = 1 AS g FROM labeled_pairs_overlap WHERE consensus IS NOT NULL"


def _sweep_sql(lo: int, hi: int, scores: str = _SCORES) -> str:
    return f"""WITH t AS (SELECT unnest(range({lo}, {hi + 1})) / 100 AS threshold), p AS ({scores}),
    c AS (SELECT strategy, threshold, count(*) FILTER (coalesce(score >= threshold, false) AND g) AS tp, count(*) FILTER (coalesce(score >= threshold, false) AND NOT g) AS fp, count(*) FILTER (NOT coalesce(score >= threshold, false) AND g) AS fn, count(*) FILTER (NOT coalesce(score >= threshold, false) AND NOT g) AS tn FROM p, t GROUP BY ALL),
    q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c)
    SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM q"""


@query(_sweep_sql(50, 99))
def s5_s6_sweep(spark, d):
    return api.calibration_sweep(_labelled(spark, d), F.col("consensus") == 1)


@query(f"SELECT * FROM ({_sweep_sql(50, 99)}) QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY f1 DESC, precision DESC, threshold) = 1")
def s7_best_threshold(spark, d):
    return stats.best(api.calibration_sweep(_labelled(spark, d), F.col("consensus") == 1))


@query(f"SELECT * FROM ({_sweep_sql(50, 99)}) QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY round(f1, 4) DESC, round(precision, 4) DESC, threshold) = 1")
def s7_best_rounded(spark, d):
    return stats.best(api.calibration_sweep(_labelled(spark, d), F.col("consensus") == 1), rounded=True)


@query(f"""WITH RECURSIVE q AS ({_sweep_sql(50, 99)}), o AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY threshold) AS i FROM q),
    w AS (SELECT strategy, i, threshold, f1 FROM o WHERE i = 1 UNION ALL SELECT o.strategy, o.i, CASE WHEN o.f1 > round(w.f1, 4) THEN o.threshold ELSE w.threshold END, CASE WHEN o.f1 > round(w.f1, 4) THEN o.f1 ELSE w.f1 END FROM w JOIN o ON o.strategy = w.strategy AND o.i = w.i + 1)
    SELECT q.* FROM q JOIN (SELECT strategy, threshold FROM w QUALIFY i = max(i) OVER (PARTITION BY strategy)) USING (strategy, threshold)""")
def s7_best_in_order(spark, d):
    return stats.best_in_order(api.calibration_sweep(_labelled(spark, d), F.col("consensus") == 1))


_BASELINES = f"""SELECT unnest(['jaccard', 'tfidf']) AS strategy, unnest([CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, cos]) AS score, g
    FROM (SELECT {_words('text_a')} AS a, {_words('text_b')} AS b, t.cos AS cos, consensus = 1 AS g FROM labeled_pairs_overlap JOIN ({_TFIDF}) t USING (id) WHERE consensus IS NOT NULL)"""


@query(_sweep_sql(*stats.BASELINE_SWEEP, _BASELINES))
def s8_baseline_sweep(spark, d):
    rows = _labelled(spark, d).withColumn("jaccard", text.token_jaccard(text.bare_words(F.col("text_a")), text.bare_words(F.col("text_b"))))
    rows = rows.join(x13_tfidf_cosine(spark, d).withColumnRenamed("cos", "tfidf"), "id")
    return stats.sweep(rows, {"jaccard": F.col("jaccard"), "tfidf": F.col("tfidf")}, F.col("consensus") == 1, stats.BASELINE_SWEEP)


@query("""WITH s AS (SELECT count(*) AS n, count(*) FILTER (label_r1 = label_r2) AS n_agree, avg(label_r1) AS p, avg(label_r2) AS q FROM labeled_pairs_overlap WHERE label_r1 IS NOT NULL AND label_r2 IS NOT NULL),
    e AS (SELECT n, n_agree, n_agree / n AS observed, p * q + (1 - p) * (1 - q) AS expected FROM s), k AS (SELECT *, (observed - expected) / (1 - expected) AS kappa FROM e)
    SELECT *, CASE WHEN kappa < 0.2 THEN 'slight' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS reading FROM k""")
def s9_cohen_kappa(spark, d):
    return stats.cohen_kappa(_labelled(spark, d), F.col("label_r1"), F.col("label_r2"))


@query("""WITH r AS (SELECT label_r1 + label_r2 + label_r3 AS k FROM labeled_pairs_overlap WHERE label_r1 + label_r2 + label_r3 IS NOT NULL),
    s AS (SELECT count(*) AS n, count(*) FILTER (k IN (0, 3)) AS n_unanimous, avg((k * (k - 1) + (3 - k) * (2 - k)) / 6) AS observed, avg(k / 3) AS p FROM r), e AS (SELECT n, n_unanimous, observed, p * p + (1 - p) * (1 - p) AS expected FROM s)
    SELECT *, CASE WHEN expected >= 1 THEN 1 ELSE (observed - expected) / (1 - expected) END AS kappa FROM e""")
def s10_fleiss_kappa(spark, d):
    return stats.fleiss_kappa(_labelled(spark, d), ["label_r1", "label_r2", "label_r3"])


@query("SELECT band, count(*) AS n, count(*) FILTER (consensus = 1) AS n_dup FROM labeled_pairs_overlap GROUP BY 1")
def s11_band_rates(spark, d):
    return _labelled(spark, d).groupBy("band").agg(F.count("*").alias("n"), F.count_if(F.col("consensus") == 1).alias("n_dup"))


@query()
def s12_bootstrap(spark, d):
    cos, lev = F.col("cos"), F.col("lev")
    points = {"semantic": cos >= 0.82, "near-exact": lev >= 0.80, "hybrid": (cos >= 0.82) & lev.between(0.30, 0.95)}
    return stats.bootstrap(_labelled(spark, d), F.col("id"), points, F.col("consensus") == 1)


@query(f"""WITH d AS (SELECT license_class AS g, count(*) AS n, count(DISTINCT {_strip('text')}) AS u FROM steps WHERE text IS NOT NULL AND license_class IS NOT NULL GROUP BY 1),
    t AS (SELECT sum(n) AS n, sum(u) AS u FROM d), e AS (SELECT d.n AS n, d.u AS u, d.n * (t.n - t.u) / t.n AS x, d.n * t.u / t.n AS y, t.n AS total FROM d, t),
    a AS (SELECT sum((n - u - x) ** 2 / x + (u - y) ** 2 / y) AS chi2, count(*) - 1 AS df, max(total) AS total FROM e), r AS (SELECT g, n, round(1 - u / n, 4) AS p FROM d),
    z AS (SELECT r.g AS g, b.p AS p1, r.p AS p2, b.n AS n1, r.n AS n2, (b.p * b.n + r.p * r.n) / (b.n + r.n) AS pooled FROM r, r b WHERE b.g = 'permissive' AND r.g <> 'permissive')
    SELECT 'all' AS test, round(chi2, 6) AS statistic, df::DOUBLE AS df, round(sqrt(chi2 / total), 6) AS effect FROM a
    UNION ALL SELECT 'permissive_vs_' || g, round(coalesce((p1 - p2) / nullif(sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2)), 0), 0), 6), NULL, round(abs(2 * asin(sqrt(p1)) - 2 * asin(sqrt(p2))), 6) FROM z""")
def s13_chi_square(spark, d):
    return s13_p_values(spark, d).select("test", F.round("statistic", 6).alias("statistic"), "df", F.round("effect", 6).alias("effect"))


@query()
def s13_p_values(spark, d):
    return stats.chi_square(profile.duplication(steps(spark, d).filter("license_class IS NOT NULL"), "license_class"), "license_class", "permissive")


@query(f"""WITH r AS (SELECT n_steps, round(dup_rate, 4) AS dup_rate FROM ({_RATE})), k AS (SELECT rank() OVER (ORDER BY n_steps) + (count(*) OVER (PARTITION BY n_steps) - 1) / 2.0 AS x, rank() OVER (ORDER BY dup_rate) + (count(*) OVER (PARTITION BY dup_rate) - 1) / 2.0 AS y FROM r)
    SELECT count(*) AS n, round(corr(x, y), 9) AS rho FROM k""")
def s14_spearman(spark, d):
    rows = profile.duplication(steps(spark, d), "repo_slug").withColumn("dup_rate", F.round("dup_rate", 4))
    return stats.spearman(rows, "n_steps", "dup_rate").withColumn("rho", F.round("rho", 9))


@query()
def s14_p_value(spark, d):
    r = s14_spearman(spark, d).first()
    return spark.createDataFrame([(r.n, r.rho, stats.spearman_p(r.n, r.rho))], "n long, rho double, p_value double")


@query(f"SELECT median(n_steps) AS size, median(dup_rate) AS rate FROM ({_RATE})")
def s15_medians(spark, d):
    return profile.duplication(steps(spark, d), "repo_slug").agg(F.median("n_steps").alias("size"), F.median("dup_rate").alias("rate"))


@query()
def s16_pair_sample(spark, d):
    return sampling.sample_pairs(steps(spark, d))
