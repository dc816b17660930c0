"""Tables written by the sinks and read back by the sources, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.session import new_path, table
from twinline.sinks import reports
from twinline.sources import files


def k1_parquet(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "steps")
    reports.write_parquet(table(spark, d, "steps"), path)
    return files.read_parquet(spark, path, "step_id", "repo_slug", "keyword", "text", "tags", "is_outline")


def k5_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "clusters")
    rows = table(spark, d, "clusters_hybrid")
    reports.write_jsonl(rows, path)
    return spark.read.schema(rows.schema).json(path).select("cluster_id", "canonical_text", "count", "member_examples")


def k8_a10_csv_repos(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "repos")
    rows = table(spark, d, "repos").filter("full_name IS NOT NULL").groupBy("full_name").agg(F.max("stargazers_count").alias("stargazers_count"))
    columns = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in table(spark, d, "repos").columns]
    reports.write_csv(rows.select(*columns), path)
    return files.read_repos(spark, path).select("repo_slug", "full_name", "stargazers_count")


def a11_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Malformed lines are skipped."""
    path = new_path(spark, "manifest")
    rows = table(spark, d, "clone_manifest")
    broken = spark.createDataFrame([("{broken",)], "value string")
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).unionByName(broken).write.text(path)
    return files.read_manifest(spark, path).select("full_name", "repo_slug", "status", "n_feature_files", "disk_kb", "commit_sha")


def a12_labelled(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "labelled")
    reports.write_jsonl(table(spark, d, "labeled_pairs_overlap").select("id", "text_a", "text_b", "cos", "lev", F.col("consensus").alias("label"), "rule"), path)
    return files.read_labelled(spark, path).select("id", "text_a", "text_b", "cos", "lev", "label", "rule")


QUERIES = {f.__name__: f for f in (k1_parquet, k5_jsonl, k8_a10_csv_repos, a11_manifest, a12_labelled)}
SQL = {
    "k1_parquet": "SELECT step_id, repo_slug, keyword, text, tags, is_outline FROM steps",
    "k5_jsonl": "SELECT cluster_id, canonical_text, count, member_examples FROM clusters_hybrid",
    "k8_a10_csv_repos": "SELECT replace(full_name, '/', '_') AS repo_slug, full_name, max(stargazers_count) AS stargazers_count FROM repos WHERE full_name IS NOT NULL GROUP BY 2",
    "a11_manifest": "SELECT full_name, replace(full_name, '/', '_') AS repo_slug, status, n_feature_files, disk_kb, commit_sha FROM clone_manifest",
    "a12_labelled": "SELECT id, text_a, text_b, cos, lev, consensus AS label, rule FROM labeled_pairs_overlap",
}
