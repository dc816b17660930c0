"""Problem 1: results of each repository and cluster text, and the dominating ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.operators.skew import dominating, ordered_totals
from twinline.session import table

SHARE = 0.04


def repo_totals(spark: SparkSession, d: str) -> DataFrame:
    return ordered_totals(table(spark, d, "steps"), F.col("repo"), F.col("file_path"), F.col("step_id"))


def text_totals(spark: SparkSession, d: str) -> DataFrame:
    return ordered_totals(table(spark, d, "clusters_hybrid"), F.col("canonical_text"), F.col("cluster_id"), F.col("cluster_id"), weight=F.col("count"))


def p1_repos(spark: SparkSession, d: str) -> DataFrame:
    return repo_totals(spark, d).select(F.col("key_val").alias("repo"), F.col("n_rows").alias("n_steps"), F.col("n_distinct").alias("n_files"))


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    return text_totals(spark, d).select(F.col("key_val").alias("canonical_text"), F.col("n_rows").alias("n_clusters"), F.col("total").alias("n_members"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys with at least 4 % of the steps, or of the clusters' counts. Shares are taken of the totals of all keys."""
    repos = dominating(repo_totals(spark, d), "n_rows", SHARE).select(F.lit("repo").alias("key_kind"), "key_val")
    texts = dominating(text_totals(spark, d), "total", SHARE).select(F.lit("canonical_text").alias("key_kind"), "key_val")
    return repos.unionByName(texts)


QUERIES = {"p1_found": p1_found, "p1_repos": p1_repos, "p1_texts": p1_texts}

SQL = {
    "p1_repos": "SELECT repo, count(*) AS n_steps, count(DISTINCT file_path) AS n_files FROM steps WHERE repo IS NOT NULL GROUP BY repo",
    "p1_texts": "SELECT canonical_text, count(*) AS n_clusters, CAST(coalesce(sum(count), 0) AS BIGINT) AS n_members FROM clusters_hybrid WHERE canonical_text IS NOT NULL GROUP BY canonical_text",
    "p1_found": """
        SELECT 'repo' AS key_kind, repo AS key_val FROM steps WHERE repo IS NOT NULL GROUP BY repo
        HAVING count(*) >= 0.04 * (SELECT count(*) FROM steps WHERE repo IS NOT NULL)
        UNION ALL
        SELECT 'canonical_text', canonical_text FROM clusters_hybrid WHERE canonical_text IS NOT NULL GROUP BY canonical_text
        HAVING sum(count) >= 0.04 * (SELECT sum(count) FROM clusters_hybrid WHERE canonical_text IS NOT NULL)""",
}
