"""Schemas of the tables that the library reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame

REPOS = "full_name string, clone_url string, default_branch string, stargazers_count int, last_pushed string, license_spdx string, license_class string, language string, archived boolean"
MANIFEST = "full_name string, status string, n_feature_files int, disk_kb long, commit_sha string, error string"
PAIR = "id long, text_a string, text_b string, cos double, lev double, cos_band string"
LABELLED = PAIR + ", label int, labeler string, rule string"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, if it has the columns; ValueError naming those that are missing otherwise."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df
