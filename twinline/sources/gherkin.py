"""Feature files as a table of steps: a line-oriented reader of the Gherkin grammar."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP = T.StructType([
    T.StructField("keyword", T.StringType()), T.StructField("text", T.StringType()), T.StructField("line", T.IntegerType()),
    T.StructField("scenario", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("is_background", T.BooleanType()), T.StructField("is_outline", T.BooleanType()),
])
PARSED = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("error", T.StringType()), T.StructField("steps", T.ArrayType(STEP))])

# Fixed values, dialects at hand without a file; load_dialects() adds all others. The words of each dialect (feature, rule, background, scenario, outline, examples, steps).
DIALECTS = {
    "en": (("Feature", "Business Need", "Ability"), ("Rule",), ("Background",), ("Example", "Scenario"), ("Scenario Outline", "Scenario Template"), ("Examples", "Scenarios"), ("* ", "Given ", "When ", "Then ", "And ", "But ")),
    "de": (("Funktionalität", "Funktion"), ("Rule", "Regel"), ("Grundlage", "Hintergrund", "Voraussetzungen", "Vorbedingungen"), ("Beispiel", "Szenario"), ("Szenariogrundriss", "Szenarien"), ("Beispiele",), ("* ", "Angenommen ", "Gegeben sei ", "Gegeben seien ", "Wenn ", "Dann ", "Und ", "Aber ")),
    "fr": (("Fonctionnalité",), ("Règle",), ("Contexte",), ("Exemple", "Scénario"), ("Plan du scénario", "Plan du Scénario"), ("Exemples",), ("* ", "Soit ", "Étant donné ", "Etant donné ", "Quand ", "Lorsque ", "Alors ", "Donc ", "Et ", "Mais ")),
    "es": (("Característica", "Necesidad del negocio", "Requisito"), ("Regla",), ("Antecedentes",), ("Ejemplo", "Escenario"), ("Esquema del escenario",), ("Ejemplos",), ("* ", "Dado ", "Dada ", "Dados ", "Dadas ", "Cuando ", "Entonces ", "Y ", "E ", "Pero ")),
    "pt": (("Funcionalidade", "Característica", "Caracteristica"), ("Regra",), ("Contexto", "Cenário de Fundo", "Cenario de Fundo", "Fundo"), ("Exemplo", "Cenário", "Cenario"), ("Esquema do Cenário", "Esquema do Cenario", "Delineação do Cenário"), ("Exemplos", "Cenários", "Cenarios"), ("* ", "Dado ", "Dada ", "Dados ", "Dadas ", "Quando ", "Então ", "Entao ", "E ", "Mas ")),
    "nl": (("Functionaliteit",), ("Rule",), ("Achtergrond",), ("Voorbeeld", "Scenario"), ("Abstract Scenario",), ("Voorbeelden",), ("* ", "Gegeven ", "Stel ", "Als ", "Wanneer ", "Dan ", "En ", "Maar ")),
    "ru": (("Функция", "Функциональность", "Функционал", "Свойство", "Фича"), ("Правило",), ("Предыстория", "Контекст"), ("Пример", "Сценарий"), ("Структура сценария", "Шаблон сценария"), ("Примеры",), ("* ", "Допустим ", "Дано ", "Пусть ", "Когда ", "Если ", "Тогда ", "То ", "И ", "К тому же ", "Но ", "А ")),
    "ja": (("フィーチャ", "機能"), ("ルール",), ("背景",), ("シナリオ",), ("シナリオアウトライン", "シナリオテンプレート", "テンプレ", "シナリオテンプレ"), ("例", "サンプル"), ("* ", "前提", "もし", "ならば", "かつ", "しかし", "但し", "ただし")),
}
_ROLES = ("feature", "rule", "background", "scenario", "outline", "examples")
_PLAIN = {"Given", "When", "Then", "And", "But", "*"}


class GherkinError(ValueError):
    pass


def _keyword(raw: str) -> str:
    kw = raw.strip()
    return kw if kw in _PLAIN else kw.rstrip("*").strip() or "*"


class _Reader:
    """One pass over the lines of a file. State is where the next line may belong."""

    def __init__(self, text: str, dialects: dict) -> None:
        self.lines = text.split("\n")  # a line ends at a line feed only; other breaks are text
        self.dialects = dialects
        self.dialect("en", 0)
        self.feature: str | None = None
        self.feature_tags: list[str] = []
        self.tags: list[str] = []
        self.tag_line = 0
        self.place = ""  # role of the open block
        self.block: list[dict] = []
        self.scenario = ""
        self.block_tags: list[str] = []
        self.has_examples = False
        self.described = True  # whether free text may come
        self.may_table = self.in_rule = False
        self.out: list[dict] = []

    def dialect(self, name: str, no: int) -> None:
        if name not in self.dialects:
            raise GherkinError(f"({no}:1): Language not supported: {name}")
        *heads, self.step_words = self.dialects[name]
        self.heads = sorted(((w, role) for role, words in zip(_ROLES, heads, strict=True) for w in words), key=lambda x: -len(x[0]))
        self.step_words = sorted(self.step_words, key=len, reverse=True)

    def close(self) -> None:
        """Gives the steps of the open block; whether it is an outline is known only now."""
        for s in self.block:
            self.out.append(s | {"is_outline": self.has_examples, "is_background": self.place == "background"})
        self.block, self.has_examples = [], False

    def head(self, role: str, name: str, no: int) -> None:
        if role == "feature":
            if self.feature is not None:
                raise GherkinError(f"({no}:1): unexpected second feature")
            self.feature, self.feature_tags = name, self.tags
        elif self.feature is None:
            raise GherkinError(f"({no}:1): expected: a feature")
        elif role == "examples":
            if self.place not in ("scenario", "outline", "examples"):
                raise GherkinError(f"({no}:1): examples outside of a scenario")
            self.has_examples = True
            self.place = "examples"
        else:
            self.close()
            if role == "background" and (self.tags or self.place not in ("feature", "rule")):
                raise GherkinError(f"({no}:1): unexpected background")
            self.place, self.scenario = role, "" if role in ("background", "rule") else name
            self.block_tags = [] if role in ("background", "rule") else self.tags
        if role == "feature":
            self.place = "feature"
        self.tags, self.described, self.may_table = [], True, role == "examples"

    def run(self) -> list[dict]:
        n = 0
        while n < len(self.lines):
            raw = self.lines[n]
            n += 1
            s = raw.strip()
            if not s:
                continue
            if s[0] == "#":
                if self.feature is None and not self.tags and s[1:].replace(" ", "").startswith("language:"):
                    self.dialect(s.split(":", 1)[1].strip(), n)
                continue
            if self.place in ("background", "scenario", "outline") and self.block and s[:3] in ('"""', "```"):
                mark, start = s[:3], n
                while n < len(self.lines) and self.lines[n].strip() != mark:
                    n += 1
                if n >= len(self.lines):
                    raise GherkinError(f"({start}:1): unexpected end of file, expected the end of a doc string")
                n += 1
                continue
            if s[0] == "@":
                self.tags = self.tags + [t for t in s.split(" #")[0].split() if t.startswith("@")]
                self.tag_line = n
                continue
            role = next(((r, s[len(w) + 1 :].strip()) for w, r in self.heads if s.startswith(f"{w}:")), None)
            if role:
                self.head(*role, n)
                continue
            if self.tags:
                raise GherkinError(f"({n}:1): expected a block after tags, got '{s}'")
            if self.place in ("background", "scenario", "outline"):
                word = next((w for w in self.step_words if s.startswith(w)), None)
                if word:
                    self.described, self.may_table = False, True
                    text = s[len(word) :].strip()
                    if text:
                        self.block.append({"keyword": _keyword(word), "text": text, "line": n, "scenario": self.scenario, "feature": self.feature, "tags": self.feature_tags + self.block_tags})
                    continue
            if s[0] == "|" and self.may_table:
                self.described = False
                continue
            if self.feature is None:
                raise GherkinError(f"({n}:1): expected: a feature, got '{s}'")
            if not self.described:
                raise GherkinError(f"({n}:1): expected: a step, got '{s}'")
        if self.tags:
            raise GherkinError(f"({self.tag_line}:1): unexpected end of file after tags")
        self.close()
        return self.out


_STEPS = ("given", "when", "then", "and", "but")


def load_dialects(path: str) -> dict:
    """The dialects of a file in the format in which all of them are published (gherkin-languages.json), and those at hand."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    heads = ("feature", "rule", "background", "scenario", "scenarioOutline", "examples")
    return DIALECTS | {name: (*(tuple(d.get(h, ())) for h in heads), tuple({w: 0 for k in _STEPS for w in d[k]})) for name, d in found.items()}


def parse_text(text: str, dialects: dict | None = None) -> tuple[list[dict], str | None]:
    """(steps, error) of one file. A file that breaks the grammar has an error and no steps; it never raises."""
    try:
        if text.startswith("\ufeff"):
            raise GherkinError("(1:1): expected: a feature, got a byte order mark")
        return _Reader(text, dialects or DIALECTS).run(), None
    except GherkinError as e:
        return [], f"parse_error: {type(e).__name__}: {e}"


def parse_files(spark: SparkSession, root: str, dialects: str | None = None, max_files: int | None = None) -> DataFrame:
    """(file_path, error, steps) of every *.feature file below root, each parsed whole in one task.

    dialects is a file for load_dialects(). max_files takes the first files by path only.
    """
    known = load_dialects(dialects) if dialects else None
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.feature").option("recursiveFileLookup", True).load(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [parse_text(bytes(c).decode("utf-8", "replace"), known) for c in pdf["content"]]
            yield pd.DataFrame({"file_path": pdf["path"], "error": [e for _, e in done], "steps": [s for s, _ in done]})

    if max_files is not None:
        files = files.join(F.broadcast(files.select("path").orderBy("path").limit(max_files)), "path", "left_semi") if max_files <= 100_000 else files.orderBy("path").limit(max_files)
    return files.select("path", "content").mapInPandas(run, PARSED)


def parse_file(spark: SparkSession, path: str) -> DataFrame:
    """parse_files() for one path. A missing file gives an error row."""
    try:
        found = parse_files(spark, path)
        found.head(1)
        return found
    except Exception as e:
        return spark.createDataFrame([(path, f"read_error: {str(e).splitlines()[0]}", [])], PARSED)


def read_steps(spark: SparkSession, root: str, dialects: str | None = None, max_files: int | None = None) -> DataFrame:
    """One row per step of the files without error: file_path and the fields of STEP."""
    parsed = parse_files(spark, root, dialects, max_files).filter("error IS NULL")
    return parsed.select("file_path", F.explode("steps").alias("s")).select("file_path", "s.*")
