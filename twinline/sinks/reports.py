"""Results as files: parquet, JSON lines, CSV, and the JSON, HTML and console reports."""

from __future__ import annotations

import html
import json
import os
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP_HTML, TOP_CONSOLE = 500, 20
MEMBER = ("keyword", "text", "file_path", "line", "scenario_name", "feature_name", "is_background", "is_outline", "tags")


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_result(row: dict, path: str) -> None:
    """A small result as one JSON file."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row, f, indent=2, ensure_ascii=False, default=str)


def _top(clusters: DataFrame, n: int) -> DataFrame:
    return clusters.orderBy(F.desc("count"), "canonical_text").limit(n)


def _with_members(clusters: DataFrame, members: DataFrame) -> Iterator[tuple[dict, Iterator[dict]]]:
    """The clusters, largest first, each with an iterator over all its members, to be read before the next cluster.

    One sorted stream of cluster rows, each followed by its member rows; the driver holds one partition at a time.
    """
    fields = [F.col(c) for c in MEMBER if c in members.columns]
    columns = clusters.columns
    each = members.select("canonical_text", F.struct(*fields).alias("m")).join(clusters, "canonical_text").select(*columns, "m")
    stream = clusters.withColumn("m", F.lit(None).cast(each.schema["m"].dataType)).unionByName(each)
    stream = stream.orderBy(F.desc("count"), "canonical_text", F.col("m").isNotNull(), "m.file_path", "m.line")
    for _, rows in groupby(stream.toLocalIterator(), key=lambda r: r["canonical_text"]):
        head = next(rows).asDict()
        del head["m"]
        yield head, (r["m"].asDict() for r in rows)


def _json(x: object, depth: int) -> str:
    """x as indented JSON at some depth. Line breaks inside strings are escaped, so those left are of the indentation."""
    return json.dumps(x, indent=2, ensure_ascii=False, default=str).replace("\n", "\n" + "  " * depth)


def write_json(summary: dict, clusters: DataFrame, members: DataFrame, path: str) -> None:
    """JSON report of all clusters, each with all its members. It's streamed, and takes its name once it is whole."""
    head = {k: summary[k] for k in ("root_path", "strategy")}
    figures = {k: v for k, v in summary.items() if k not in head} | {"exact_duplication_rate": round(summary["exact_duplication_rate"], 4)}
    data = {"schema_version": 1, **head, "generated_at": datetime.now(UTC).isoformat(), "summary": figures}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(_json(data, 0).removesuffix("\n}") + ',\n  "clusters": [')
        between = ""
        for c, its in _with_members(clusters, members):
            f.write(between + "\n    " + _json(c, 2).removesuffix("\n    }") + ',\n      "members": [')
            comma = ""
            for m in its:
                f.write(comma + "\n        " + _json(m, 4))
                comma = ","
            f.write(("\n      " if comma else "") + "]\n    }")
            between = ","
        f.write(("\n  " if between else "") + "]\n}")
    os.replace(f"{path}.part", path)


_STYLE = "body{font-family:sans-serif;max-width:70em;margin:2em auto}dl{display:flex;flex-wrap:wrap;gap:1em}dt{color:#555}dd{margin:0;font-size:1.3em}td{padding:0 .6em;font-family:monospace}.bg,.ol{font-style:italic}"


def write_html(summary: dict, clusters: DataFrame, members: DataFrame, path: str, top_n: int | None = TOP_HTML) -> None:
    """One HTML page with a collapsible card for each of the largest clusters, or all without top_n, with all its members; all text is escaped."""
    esc = lambda x: html.escape(str(x))
    total = clusters.count()
    tiles = "".join(f"<div><dt>{esc(k)}</dt><dd>{esc(v)}</dd></div>" for k, v in summary.items())
    note = f"<p>The {top_n} largest of {total} clusters are shown. The JSON report has all.</p>" if top_n is not None and total > top_n else ""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<!doctype html><html lang="en"><meta charset="utf-8"><title>Duplicate steps</title><style>{_STYLE}</style><h1>Duplicate steps</h1><dl>{tiles}</dl>{note}')
        for c, its in _with_members(clusters if top_n is None else _top(clusters, top_n), members):
            f.write(f"<details><summary><b>{c['count']}</b> in {c['occurrence_files']} files: {esc(c['canonical_text'])}</summary><table>")
            for m in its:
                mark = "bg" if m.get("is_background") else "ol" if m.get("is_outline") else ""
                f.write(f'<tr class="{mark}"><td>{esc(m.get("file_path", ""))}</td><td>{esc(m.get("line", ""))}</td><td>{esc(m.get("keyword", ""))}</td><td>{esc(m.get("text", ""))}</td></tr>')
            f.write("</table></details>")
        f.write(f"<p>Strategy: {esc(summary['strategy'])}.</p></html>")


def console(clusters: DataFrame, n: int = TOP_CONSOLE) -> DataFrame:
    """The largest clusters with their texts cut to a line."""
    from twinline.functions.text import snippet

    return _top(clusters, n).select("count", "occurrence_files", snippet(F.col("canonical_text")).alias("text"))
