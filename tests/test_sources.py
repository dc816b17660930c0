import json
import os

import pytest
from pyspark.sql import functions as F

from twinline import api
from twinline.schemas import require_columns
from twinline.sources import files, gherkin

PLAIN = "Feature: Shop\n  Some words about it\n\n  Scenario: Buy\n    Given a cart\n    When I pay\n    Then it is sent\n"
RICH = """@shop @slow
Feature: Shop
  Background:
    Given a user
    And a cart

  @fast
  Scenario: Buy
    When I pay
    * it is sent

  Scenario Outline: Roles
    Given the role <role>
    Then it is <role>
    Examples:
      | role |
      | one  |

  Scenario Outline: No rows
    Given nothing <x>

  Scenario: Doc
    Given a text
      \"\"\"
      When this is no step
      \"\"\"
    And a table
      | a | b |
"""
RULES = "Feature: F\n  @ruled\n  Rule: one\n    Scenario: a\n      Given x\n  Rule: two\n    Background:\n      Given b\n    Example: c\n      Then y\n"


def test_plain_file():
    steps, error = gherkin.parse_text(PLAIN)
    assert error is None
    assert [(s["keyword"], s["text"], s["line"]) for s in steps] == [("Given", "a cart", 5), ("When", "I pay", 6), ("Then", "it is sent", 7)]
    assert {(s["scenario"], s["feature"], s["is_background"], s["is_outline"]) for s in steps} == {("Buy", "Shop", False, False)}


def test_blocks_tags_and_outlines():
    steps, error = gherkin.parse_text(RICH)
    assert error is None and len(steps) == 9
    assert [s["text"] for s in steps if s["is_background"]] == ["a user", "a cart"]
    assert {s["text"] for s in steps if s["is_outline"]} == {"the role <role>", "it is <role>"}
    assert all(s["tags"][:2] == ["@shop", "@slow"] for s in steps)
    assert [s["keyword"] for s in steps if len(s["tags"]) == 3] == ["When", "*"]
    assert all(s["scenario"] == "" for s in steps if s["is_background"])


def test_rules_are_flattened_and_their_tags_ignored():
    steps, error = gherkin.parse_text(RULES)
    assert error is None and [s["text"] for s in steps] == ["x", "b", "y"]
    assert all(s["tags"] == [] for s in steps)


@pytest.mark.parametrize("text", [
    "Feature: x\n Scenario: y\n  Given a\n   \"\"\"\n open",  # doc string never closed
    "﻿Feature: x\n",
    "no feature here\n",
    "Feature: x\n Scenario: y\n  Given a\n  stray words\n",
    "Feature: x\n @tag\n  Given a\n",
    "# language: xx\nFeature: x\n",
    "Feature: a\nFeature: b\n",
    "Feature: a\n @late\n",
])
def test_broken_files_have_an_error_and_no_steps(text):
    steps, error = gherkin.parse_text(text)
    assert steps == [] and error.startswith("parse_error: GherkinError")


def test_empty_files_and_dialects():
    assert gherkin.parse_text("") == ([], None)
    assert gherkin.parse_text("# only a comment\n") == ([], None)
    steps, error = gherkin.parse_text("# language: de\nFunktionalität: x\n  Szenario: y\n    Angenommen ein Text\n    Dann ist er da\n")
    assert error is None and [(s["keyword"], s["text"]) for s in steps] == [("Angenommen", "ein Text"), ("Dann", "ist er da")]
    steps, _ = gherkin.parse_text("# language: ja\nフィーチャ: x\n  シナリオ: y\n    前提ログインしている\n")
    assert [(s["keyword"], s["text"]) for s in steps] == [("前提", "ログインしている")]


def test_only_a_line_feed_ends_a_line():
    steps, error = gherkin.parse_text("Feature: F\r\n  Scenario: S\r\n    Given a\u2028b\x0bc\u0085d\x0ce\r\n    Then x\n")
    assert error is None and [(s["text"], s["line"]) for s in steps] == [("a\u2028b\x0bc\u0085d\x0ce", 3), ("x", 4)]


def test_dialects_from_a_file(spark, tmp_path):
    words = {"feature": ["Funzionalità"], "background": ["Contesto"], "rule": ["Regola"], "scenario": ["Scenario"], "scenarioOutline": ["Schema dello scenario"], "examples": ["Esempi"],
             "given": ["* ", "Dato "], "when": ["* ", "Quando "], "then": ["* ", "Allora "], "and": ["* ", "E "], "but": ["* ", "Ma "]}
    (tmp_path / "languages.json").write_text(json.dumps({"it": words}))
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.feature").write_text("# language: it\nFunzionalità: F\n  Scenario: S\n    Dato un testo\n    Allora c'è\n")
    (tmp_path / "f/b.feature").write_text(PLAIN)
    assert gherkin.parse_text((tmp_path / "f/a.feature").read_text())[1] is not None
    got = gherkin.read_steps(spark, str(tmp_path / "f"), str(tmp_path / "languages.json")).collect()
    assert sorted((r.keyword, r.text) for r in got)[:2] == [("Allora", "c'è"), ("Dato", "un testo")] and len(got) == 5
    assert gherkin.parse_files(spark, str(tmp_path / "f"), max_files=1).count() == 1


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/one.feature").write_text(PLAIN)
    (tmp_path / "a/b/two.feature").write_text(RICH)
    (tmp_path / "a/bad.feature").write_text("no feature\n")
    (tmp_path / "a/bytes.feature").write_bytes(b"Feature: \xff\n Scenario: s\n  Given a \xfe b\n")
    (tmp_path / "a/notes.txt").write_text(PLAIN)
    return str(tmp_path)


def test_directories(spark, folder):
    parsed = gherkin.parse_files(spark, folder)
    assert {r.file_path.rsplit("/", 1)[1]: len(r.steps) for r in parsed.collect()} == {"one.feature": 3, "two.feature": 9, "bad.feature": 0, "bytes.feature": 1}
    assert gherkin.read_steps(spark, folder).filter(F.col("text").contains("�")).count() == 1
    assert gherkin.parse_file(spark, folder + "/none.feature").first().error.startswith("read_error:")


def test_reports_and_stats(spark, folder, tmp_path):
    s = api.stats_of(spark, folder).first()
    assert (s.n_feature_files, s.n_parse_errors, s.n_steps, s.n_background) == (4, 1, 13, 2)
    (tmp_path / "a/three.feature").write_text(PLAIN.replace("a cart", 'a "<b>" cart'))
    out = str(tmp_path / "out.html")
    report = api.find_duplicates(spark, folder, out)
    data = json.load(open(str(tmp_path / "out.json")))
    assert data["schema_version"] == 1 and data["summary"]["n_steps"] == 16
    assert data["summary"]["n_duplicate_clusters"] == len(data["clusters"]) == report.clusters.count()
    assert all(len(c["members"]) == c["count"] for c in data["clusters"])
    page = open(out).read()
    assert "<b>I pay" not in page and "I pay" in page
    assert api.analyse(spark, folder, "hybrid").clusters.count() == report.clusters.count()
    with pytest.raises(ValueError):
        api.analyse(spark, folder, "best")


def test_html_is_escaped(spark, rows, tmp_path):
    from twinline.sinks import reports

    c = rows([("<script>", "exact", 2, 1)], "canonical_text string, strategy string, count long, occurrence_files long")
    m = rows([("<script>", "Given", "<script>", "f", 1, False, True)], "canonical_text string, keyword string, text string, file_path string, line int, is_background boolean, is_outline boolean")
    reports.write_html({"strategy": "exact"}, c, m, str(tmp_path / "x.html"))
    more = c.union(rows([("b", "exact", 1, 1)], c.schema))
    for top, n in ((1, 1), (None, 2), (500, 2)):
        reports.write_html({"strategy": "exact"}, more, m, str(tmp_path / "y.html"), top_n=top)
        assert (tmp_path / "y.html").read_text().count("<details>") == n
    page = (tmp_path / "x.html").read_text()
    assert "<script>" not in page and "&lt;script&gt;" in page and 'class="ol"' in page


def test_json_holds_all_clusters_and_members(spark, tmp_path):
    from twinline.sinks import reports

    c = spark.range(600).selectExpr("'text\u2028 ' || id AS canonical_text", "'exact' AS strategy", "IF(id = 7, 120L, 2L) AS count", "1L AS occurrence_files")
    m = c.selectExpr("canonical_text", "explode(sequence(1, int(count))) AS line", "'Given' AS keyword", "canonical_text AS text", "'f' AS file_path", "array('@a') AS tags")
    extra = c.limit(1).selectExpr("'none' AS canonical_text", "strategy", "1L AS count", "0L AS occurrence_files")
    head = {"root_path": "é", "strategy": "exact", "exact_duplication_rate": 0.123456, "n_duplicate_clusters": 601}
    reports.write_json(head, c.union(extra), m, str(tmp_path / "new/x.json"))
    raw = (tmp_path / "new/x.json").read_text(encoding="utf-8")
    data = json.loads(raw)
    assert raw == json.dumps(data, indent=2, ensure_ascii=False) and os.listdir(tmp_path / "new") == ["x.json"]
    assert data["root_path"] == "é" and data["summary"] == {"n_duplicate_clusters": 601, "exact_duplication_rate": 0.1235}
    got = data["clusters"]
    assert [x["count"] for x in got] == [120] + [2] * 599 + [1] and got[-1]["members"] == []
    assert [x["line"] for x in got[0]["members"]] == list(range(1, 121))
    assert all(len(x["members"]) == x["count"] and {y["text"] for y in x["members"]} == {x["canonical_text"]} for x in got[:-1])
    reports.write_json(head, c.limit(0), m, str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text())["clusters"] == []
    reports.write_html(head, c, m, str(tmp_path / "x.html"))
    page = (tmp_path / "x.html").read_text()
    assert page.count("<details>") == 500 and page.count("<tr") == 120 + 499 * 2 and "500 largest of 600" in page


def test_files(spark, tmp_path):
    (tmp_path / "repos.csv").write_text("full_name,clone_url,default_branch,stargazers_count,last_pushed,license_spdx,license_class,language,archived\na/b,u,main,1,2020,MIT,permissive,C,false\na/b,u,main,2,2021,MIT,permissive,C,false\n")
    assert [(r.repo_slug, r.stargazers_count) for r in files.read_repos(spark, str(tmp_path / "repos.csv")).collect()] == [("a_b", 2)]
    (tmp_path / "m.jsonl").write_text('{"full_name": "a/b", "status": "ok"}\nnot json\n{"full_name": "a/b", "status": "late"}\n')
    assert [r.status for r in files.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()] == ["late"]
    (tmp_path / "p.jsonl").write_text('{"cos": 0.9, "lev": 0.8, "label": 1}\n')
    assert files.read_labelled(spark, str(tmp_path / "p.jsonl")).count() == 1
    (tmp_path / "q.jsonl").write_text('{"cos": 0.9}\n')
    with pytest.raises(ValueError):
        files.read_labelled(spark, str(tmp_path / "q.jsonl"))
    with pytest.raises(ValueError):
        require_columns(spark.range(1), "text")


def test_stream(spark, tmp_path):
    from twinline.streaming.counts import stream_counts

    spark.createDataFrame([("a  b",), ("a b",), ("c",)], "text string").write.parquet(str(tmp_path / "in"))
    q = stream_counts(spark.readStream.schema("text string").parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("exact_counts").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("exact_counts").collect()] == [("a b", 2)]


def test_windows_close_once_the_watermark_passed(spark, tmp_path):
    from datetime import datetime

    from twinline.streaming.counts import windowed_counts

    folder = str(tmp_path / "in")
    schema = "text string, at timestamp"
    q = windowed_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*")), "at", "1 day", "1 day")
    for i, data in enumerate([[("a  b", datetime(2030, 1, 1, 5)), ("a b", datetime(2030, 1, 1, 6)), (" ", datetime(2030, 1, 1, 6))], [("c", datetime(2030, 1, 5))]]):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}{i}")
    run = q.writeStream.outputMode("append").format("memory").queryName("windowed").start()
    run.processAllAvailable()
    run.stop()
    assert [(r.start, r.canonical_text, r["count"]) for r in spark.table("windowed").collect()] == [(datetime(2030, 1, 1), "a b", 2)]
