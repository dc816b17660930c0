import collections
import itertools
import random
import re
import unicodedata

from pyspark.sql import functions as F

from twinline.llm import copies
from twinline.llm.form import consistent
from twinline.operators.skew import salted_join

SCHEMA = "id long, text string, h long, key long, n long"


def letters(t):
    return "".join(c for c in t if c.isalnum())


def readings(s):
    """All sequences of letters and digits that a text in consistent form gives, its fields in any order."""
    out = [""]
    for part in re.split(r"(\{[^{}]*\})", s):
        if re.fullmatch(r"\{[^{}]*\}", part):
            orders = {"".join(p) for p in itertools.permutations([letters(x) for x in part[1:-1].split(",")])}
        else:
            orders = {letters(part)}
        out = [x + y for x in out for y in orders]
    return set(out)


def brute(data):
    """Groups of texts that share a reading, closed."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    own = []
    for i, t in data:
        if t is not None and i is not None:
            all_ = sorted(readings(consistent(t).lower()))
            if all_[0]:
                own.append((i, t, all_[0]))
                for r in all_:
                    parent[find(r)] = find(all_[0])
    groups = collections.defaultdict(list)
    for i, t, r in own:
        groups[find(r)].append((i, t))
    out = set()
    for g in groups.values():
        if len({t for _, t in g}) > 1:
            first = min(i for i, _ in g)
            out |= {(first, i) for i, _ in g if i != first}
    return out


def pairs(rows, data):
    df = rows([(i, t, 0, 0, 0) for i, t in data], SCHEMA)
    got = [tuple(r) for r in copies.copy_pairs(df, F.col("id"), F.col("text")).collect()]
    assert len(got) == len(set(got))
    return set(got)


CASES = ["I see it.", "i  SEE it", "I see it.", "Ｉ see it", "I see​ it!", None, "", " ", "--", "?", "I saw it",
         '{a: 1, b: "x"}', '{b: "x", a: 1}', "{ A: 1,  B: x }", "{b: x a: 1}", "{a: 1 b: x}", "{a: 1, b: x, a: 1}", "{a: 1, a: 1, b: x}", "{open a: 1", "open} {a: 1",
         "x {p, q} y {r, s}", "x {q, p} y {s, r}", "x {r, s} y {p, q}", "{x{b,a}}", "{x{a,b}}", "ÉÀ", "éà", "Straße", "STRASSE", "l" * 100_000, "L" * 100_000 + "."]


def test_cases_equal_brute_force(rows):
    data = list(enumerate(CASES, 1)) + [(None, "I see it."), (100, "I see it.")]
    assert pairs(rows, data) == brute(data)


def test_random_fields_equal_brute_force(rows):
    rng = random.Random(2)
    data = []
    for i in range(400):
        fields = [f"k{k}: {rng.choice('ab')}" for k in range(rng.randint(1, 3))]
        rng.shuffle(fields)
        t = rng.choice(["post ", "Post  "]) + "{" + rng.choice([",", " , ", " "]).join(fields) + "}"
        data.append((i, rng.choice([t, t.upper(), t + "!"])))
    assert pairs(rows, data) == brute(data)


def test_one_group_with_most_rows(rows):
    data = [(i, rng_text) for i in range(3000) for rng_text in ["one phrase" if i % 3 else f"phrase {i}"]] + [(5000, "One phrase.")]
    assert pairs(rows, data) == brute(data)


def test_phrases_and_emptiness(rows):
    df = rows([(3, "a b", 0, 0, 0), (1, "A-B", 0, 0, 0), (2, "a b", 0, 0, 0), (4, None, 0, 0, 0), (5, "c", 0, 0, 0)], SCHEMA)
    got = {tuple(r) for r in copies.phrases(df, F.col("id"), F.col("text")).collect()}
    assert got == {(1, "A-B", 2, 3), (5, "c", 1, 1)}
    assert copies.copy_pairs(df.limit(0), F.col("id"), F.col("text")).count() == 0


def test_colliding_hashes_are_told_apart(rows, monkeypatch):
    """With all hashes equal, comparison alone must keep phrases apart. It runs in this process, on the plain functions."""
    assert not copies.same_phrase("abc", "abd") and copies.same_phrase("a-bc", "ABC") and not copies.same_phrase("abc", "abcd")
    assert copies.same_phrase("{a:1, b:2}", "{b:2, a:1}") and not copies.same_phrase("{a:1, b:2}", "{a:2, b:1}")


def test_folding_equals_the_consistent_form():
    """Character by character: what the table makes of a text is the letters and digits of its consistent form, lower-cased."""
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x340), *range(0x370, 0x460), 0x1100, 0x1161, 0xAC00, 0xFF76, 0xFF9E, 0x3099, 0x304B, 0x200B, 0x200D, 0x1F600, 0x212B, 0x958, 0xFB01, 0xFF21, 0xFF5B, 0xFF5D, 0xFF0C, 0x1EBF, 0x2163, 0x130, 0x1E9E]]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    symbols, starts = copies.folded(texts)
    for i, t in enumerate(texts):
        own = symbols[starts[i] : starts[i + 1]]
        want = [ord(c.lower()[0]) for c in consistent(t) if c in "{}," or (c.isascii() and c.isalnum()) or (not c.isascii() and unicodedata.category(c)[0] in "LN")]
        assert own[own > 0].tolist() == want, t


def test_many_equal_fields_are_counted():
    """200 equal fields and another one, at any place; the number of states is what bounds the steps."""
    zeros = ["0"] * 200
    x = "row {" + ", ".join([*zeros, "a"]) + "}"
    for at in (0, 100, 200):
        y = "row " + " ".join([*zeros[:at], "a", *zeros[at:]])
        assert copies.fields_match(x, y) and not copies.fields_match(x, y + " a") and not copies.fields_match(x, y.replace("a", "b"))
    distinct = [f"field {k}" for k in range(200)]
    assert copies.fields_match("{" + ", ".join(distinct) + "}", " ".join(reversed(distinct)))


def test_rows_of_equal_fields(rows):
    zeros = " ".join("0" * 60)
    data = list(enumerate(["row {" + zeros.replace(" ", ", ") + ", a}", f"row a {zeros}", f"row {zeros} a", "row " + zeros[:59] + " a " + zeros[60:], f"row b {zeros}"]))
    assert pairs(rows, data) == {(0, 1), (0, 2), (0, 3)}


def test_permuted_digits_meet_only_where_a_field_agrees(rows):
    """Phrases of the same digits don't all meet: the number of pairs to compare grows with the phrases, not with their square."""
    found = {}
    for n in (200, 800):
        rng = random.Random(4)
        data = []
        for i in range(n):
            digits = list("0123456789")
            rng.shuffle(digits)
            a, b = "".join(digits[:5]), "".join(digits[5:])
            data += [(4 * i, f"order {{{a}, {b}}}", 0, 0, 0), (4 * i + 1, f"order {b} {a}", 0, 0, 0), (4 * i + 2, f"Order {{{b},{a}}}", 0, 0, 0)]
        df = rows(data, SCHEMA)
        texts = copies.open_phrases(copies.distinct_spellings(df, F.col("id"), F.col("text")))
        found[n] = copies.links(texts).count()
    # About half of the plain ones read as the fields in the order of their hashes, and have the same hash anyway.
    assert 80 <= found[200] <= 140 and found[800] <= 5 * found[200]


def test_most_rows_in_one_spelling_and_in_blanks(spark, rows):
    """Nine tenths of the rows have one text without another spelling, or none with letters; they are cut into pieces."""
    data = [(i, "the one text", 0, 0, 0) for i in range(6000)] + [(10_000 + i, "--", 0, 0, 0) for i in range(3000)] + [(20_000 + i, f"text {i // 2}" + "." * (i % 2), 0, 0, 0) for i in range(1000)]
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        df = rows(data, SCHEMA)
        distinct = copies.distinct_spellings(df, F.col("id"), F.col("text"))
        key = F.xxhash64("spelling").alias("key")
        got = salted_join(df.select(F.col("id").alias("copy_id"), F.xxhash64("text").alias("key")), distinct.select(key, "n"), "key", distinct.select(key, "n"), F.col("copy_id"))
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 10_000 and max(sizes) < 2500
        assert copies.copy_pairs(df, F.col("id"), F.col("text")).count() == 500
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
