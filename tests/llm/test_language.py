import pytest
from pyspark.sql import functions as F

from twinline.llm import language as lg

SAMPLES = {
    "en": ["the invoice list should hold two rows", "no mail was sent to the admin", "each step should say clearly what it expects", "the service was restarted some minutes ago", "please keep the steps short because long sentences are hard to reuse"],
    "de": ["die Liste der Rechnungen wird nicht geändert", "ich befinde mich auf der Hilfeseite", "der Dienst wurde vor einigen Minuten neu gestartet", "bitte haltet die Schritte kurz, weil lange Sätze schwer sind", "nur die Prüferin weiß, warum das so ist"],
    "ru": ["система не меняет профиль устройства", "я открываю страницу отчётов", "в этой главе описано, как мы проверяем ключ", "пока неясно, что произойдёт после полуночи"],
}
EN, DE, RU = "the list should hold the rows that we expect", "ich weiß nicht, warum die Liste geändert wurde", "мы проверяем, как система меняет страницу отчётов"


@pytest.fixture(scope="module")
def trees():
    return lg.Trees([(k, t) for k, v in SAMPLES.items() for t in v])


def test_code_lengths_equal_the_definition(trees):
    """Against a slow version that walks down the contexts byte by byte."""
    import math
    from collections import Counter

    order = lg.ORDER
    counts = {}
    for k, v in SAMPLES.items():
        c = counts[k] = Counter()
        for t in v:
            data = b" " + b" ".join(b.encode() for b in lg.blocks_of(t)) + b" "
            c.update(data[i:j] for i in range(len(data)) for j in range(i + 1, min(i + order + 1, len(data)) + 1))

    def bits(c, context, byte):
        out = 0.0
        for n in range(min(order, len(context)), -1, -1):
            ctx = context[len(context) - n :]
            after = {bytes([b]): c[ctx + bytes([b])] for b in range(256) if c[ctx + bytes([b])]}
            if not after:
                continue
            total = sum(after.values()) + len(after)
            if byte in after:
                return out - math.log2(after[byte] / total)
            out -= math.log2(len(after) / total)
        return out + 8

    texts = ["the step", "ändern zz", "страница", "日"]
    got = trees.code_lengths(texts)
    data = (" " + " ".join(texts) + " ").encode()
    for j, k in enumerate(trees.languages):
        at = 1
        for i, t in enumerate(texts):
            end = at + len(t.encode()) + 1
            want = sum(bits(counts[k], data[max(0, p - order) : p], data[p : p + 1]) for p in range(at, end))
            assert got[i, j] == pytest.approx(want, rel=1e-4)
            at = end


def run(rows, trees, data):
    df = rows([(i, t, lang, "x", "x") for i, t, lang in data], "doc_id long, text string, lang string, label string, block_no string")
    return sorted(tuple(r) for r in lg.mislabelled(df, "doc_id", "text", "lang", trees).collect())


def test_labels(rows, trees):
    long_en, long_de = f"{EN}. {EN}.", f"{DE}. {DE}."
    data = [(1, long_en, "en"), (2, long_en, " EN"), (3, long_en, "en_GB"), (4, long_en, "de"), (5, long_en, None), (6, long_en, " "), (7, long_en, "n/a"), (8, long_de, "en-US"), (9, RU, "uk"), (10, None, "en"), (11, "", None), (12, "  \n \n", None), (13, "short", "de"), (14, "12 34 { } ;", None)]
    assert run(rows, trees, data) == [(4, 0, "en"), (5, 0, "en"), (6, 0, "en"), (7, 0, "en"), (8, 0, "de"), (9, 0, "ru")]


def test_runs_of_blocks(rows, trees):
    mixed = f"\n\n{EN}. {EN}\n\n```\nx = 1\n\ny = 2\n```\n\n| {DE} |\n\n{EN}\r\n \t\r\n{DE}\n{DE}\n\n{RU}\n\n"
    # Blocks: 1 English, 2 and 3 code, 4 a table, 5 English, 6 German, 7 Russian.
    assert run(rows, trees, [(1, mixed, "en")]) == [(1, 1, "en"), (1, 6, "de"), (1, 7, "ru")]
    code = f'{EN}. {EN}\n\n@tag @{DE.replace(" ", "_")}\n\n"{DE}" "{DE}"\n\n{EN}'
    assert run(rows, trees, [(1, code, "en")]) == []
    assert run(rows, trees, [(1, code, None), (1, code, None)]) == [(1, 0, "en")] * 2


def test_held_out_accuracy(trees):
    held = {"en": ["the admin restarted the service", "the steps are short and clear"], "de": ["der Dienst wird neu gestartet", "die Schritte sind kurz"], "ru": ["я открываю профиль устройства", "что произойдёт с системой"]}
    texts = [(k, t) for k, v in held.items() for t in v]
    best = trees.code_lengths([lg.blocks_of(t)[0] for _, t in texts]).argmin(axis=1)
    assert [trees.languages[b] for b in best] == [k for k, _ in texts]


def test_detect_and_emptiness(rows, trees, spark):
    df = rows([(1, f"{EN}. " * 2000, None), (None, DE, None)], "doc_id long, text string, lang string")
    got = {(r.doc_id, r.block_no, r.lang_code) for r in lg.detect(df, "doc_id", "text", trees).collect()}
    assert got == {(1, 0, "en"), (None, 0, "de")}
    assert all(0 < r.confidence <= 1 for r in lg.detect(df, "doc_id", "text", trees).collect())
    assert lg.detect(df.limit(0), "doc_id", "text", trees).count() == 0
    none = lg.fit(rows([], "lang string, text string, id long"), "lang", "text", "id")
    assert none.languages == [] and lg.detect(df, "doc_id", "text", none).count() == 0
    assert lg.fit(rows([("en", EN, 1), (None, DE, 2), ("de", None, 3)], "lang string, text string, id long"), "lang", "text", "id").languages == ["en"]
