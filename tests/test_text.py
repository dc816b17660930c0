import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinline.functions import text
from twinline.functions.edit import common_length, indel_ratio, ratios


def one(rows, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = rows([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(f(*(F.col(n) for n in names))).first()[0]


def test_normalise_collapses_all_white_space(rows):
    assert one(rows, text.normalise, " a\x0bb\xa0c d  e\x1cf\n") == "a b c d e f"
    assert one(rows, text.normalise, "User CLICKS") == "User CLICKS"
    assert one(rows, text.normalise, None) is None
    assert one(rows, text.strip_ends, "　 a  b\t") == "a  b"


def test_white_space_is_python_s(spark):
    data = spark.createDataFrame([(i, f"a{chr(i)}b") for i in range(1, 0x3100)], "id int, t string")
    got = {r[0] for r in data.filter(text.normalise(F.col("t")) == "a b").collect()}
    assert got == {i for i in range(1, 0x3100) if re.fullmatch(r"\s", chr(i))}


@pytest.mark.parametrize(("raw", "want"), [("Given ", "Given"), ("* ", "*"), ("Wenn", "Wenn"), ("Und*", "Und"), ("***", "*"), ("", "*")])
def test_keyword(rows, raw, want):
    assert one(rows, text.keyword_of, raw) == want


def test_hash_is_blake2b_of_the_normalised_text(rows):
    h = one(rows, text.content_hash, "a  b ")
    assert h == hashlib.blake2b(b"a b", digest_size=16).hexdigest() and len(h) == 32


def test_quoted_bare_and_jaccard(rows):
    assert one(rows, text.quoted_count, """a "x" and 'y' "z\\" """) == 2
    assert one(rows, text.bare_words, 'I see "Save" on page 12, <role>!') == "i see param on page param param"
    assert one(rows, text.token_jaccard, "a b c", "b c d") == 0.5
    assert one(rows, text.token_jaccard, "", "a") == 0.0


@pytest.mark.parametrize(("spdx", "want"), [(None, "unlicensed"), (" ", "unlicensed"), ("MIT", "permissive"), ("GPL-3.0", "copyleft"), ("NOASSERTION", "unknown")])
def test_license_class(rows, spdx, want):
    assert one(rows, text.license_class_of, spdx) == want


def test_small_functions(rows):
    assert one(rows, text.snippet, "x" * 81) == "x" * 77 + "..."
    assert one(rows, text.snippet, "x" * 80) == "x" * 80
    assert one(rows, text.cut_at_word, "word " * 20) == ("word " * 12).strip()
    assert one(rows, lambda c: F.concat_ws("|", *text.split_path(c)), "a_b\\c/d.feature") == "a_b|c/d.feature"
    assert one(rows, lambda a, b: text.length_compatible(a, b, 0.9), "", "") is True
    assert one(rows, lambda a, b: text.length_compatible(a, b, 0.9), "", "a") is False
    assert one(rows, lambda a, b: text.length_compatible(a, b, 0.9), "abcd", "abcdefgh") is False


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abcä日\0", max_size=70), st.text("abcä日\0", max_size=70)), min_size=1, max_size=5))
def test_edit_similarity_matches_the_textbook(pairs):
    want = [1.0 if not a + b else 2 * plain_lcs(a, b) / (len(a) + len(b)) for a, b in pairs]
    assert ratios([a for a, _ in pairs], [b for _, b in pairs]).tolist() == pytest.approx(want)
    assert all(common_length(a, b) == plain_lcs(a, b) for a, b in pairs)


def test_indel_is_not_levenshtein(rows):
    assert one(rows, indel_ratio, "the user is logged in", "the user is logged out") == pytest.approx(2 * 19 / 43)
    assert one(rows, indel_ratio, " ", "") == 1.0
    assert one(rows, indel_ratio, "a", None) is None
