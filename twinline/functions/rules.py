"""Rule labellers for pairs of step texts, each one native expression that gives struct(label, rule)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinline.functions.text import WHITE, bare_words, strip_ends, words_of

# The word lists that the rules are stated with.
VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
NEGATED = ("should", "has", "is", "does", "can", "will", "was", "are")
EXISTENCE = ("should exist", "should not exist", "is listed", "is not listed")
CONTENT = ("the content of", "should be", "should contain", "equals")
ASSERTION_STARTS = ("should ", "is ", "are ", "has ", "have ", "the response ", "check ")
ACTION_STARTS = (
    "i ", "user ", "they ", "click ", "tap ", "press ", "fill ", "submit ", "go ",
    "visit ", "open ", "create ", "delete ", "update ", "edit ", "follow ", "run ",
)
SYNONYMS = (
    ("get", "fetch", "retrieve", "receive"), ("send", "submit", "post"), ("should", "shall", "must"),
    ("click", "tap", "press", "hit"), ("see", "view", "observe"), ("return", "returns", "response"),
    ("status", "statuscode", "statuses"), ("is", "are", "equals", "==", "="), ("200", "200ok", "ok"), ("the", "a", "an"),
)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions)


def _either(f, a: Column, b: Column) -> Column:
    """f(a, b) or f(b, a)."""
    return f(a, b) | f(b, a)


def _has(text: Column, marks: tuple[str, ...]) -> Column:
    return _any([text.contains(m) for m in marks])


def _starts(text: Column, starts: tuple[str, ...]) -> Column:
    return _any([text.startswith(s) for s in starts])


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), f"[{WHITE}]+"), lambda w: w != ""))


def _differences(a: Column, b: Column) -> Column:
    return F.concat(F.array_except(_tokens(a), _tokens(b)), F.array_except(_tokens(b), _tokens(a)))


def _within(tokens: Column, allowed: tuple[str, ...]) -> Column:
    return F.forall(tokens, lambda t: t.isin(*allowed))


def http_verb(text: Column) -> Column:
    """The first verb, in the order of VERBS, that the text names in quotes or as a word."""
    padded = F.concat(F.lit(" "), strip_ends(text), F.lit(" "))
    return F.coalesce(*(F.when(text.contains(f'"{v}"') | padded.contains(f" {v} "), v) for v in VERBS))


def call_against_callonce(a: Column, b: Column) -> Column:
    once, call = r"(?U)(?<!\w)callonce(?!\w)", r"(?U)(?<!\w)call(?!\w)"
    return _either(lambda x, y: x.rlike(call) & ~x.rlike(once) & y.rlike(once), a, b)


def def_against_set(a: Column, b: Column) -> Column:
    return _either(lambda x, y: strip_ends(x).startswith("def ") & strip_ends(y).startswith("set "), a, b)


def polarity_flip(a: Column, b: Column) -> Column:
    """One text negates what the other states, or they differ in nothing but words of negation."""
    def flips(x: Column, y: Column) -> Column:
        return _any([x.rlike(_no(w)) & y.rlike(rf"(?U)\b{w}\b") & ~y.rlike(_no(w)) for w in NEGATED])

    return _either(flips, a, b) | _within(_differences(a, b), ("not", "should", "shouldn't"))


def _no(word: str) -> str:
    return r"(?U)\bcan not\b|\bcannot\b" if word == "can" else rf"(?U)\b{word} not\b"


def presence_against_content(a: Column, b: Column) -> Column:
    content = (*CONTENT, "== ")
    return _either(lambda x, y: _has(x, EXISTENCE) & _has(y, content) & ~_has(x, content), F.lower(a), F.lower(b))


def action_against_assertion(a: Column, b: Column) -> Column:
    def action(x: Column) -> Column:
        return _starts(x, ACTION_STARTS) & ~_starts(x, ASSERTION_STARTS)

    return _either(lambda x, y: action(x) & y.contains("should") & ~x.contains("should"), strip_ends(F.lower(a)), strip_ends(F.lower(b)))


def _verdict(label: int, rule: str) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(rule).alias("rule"))


def _chain(rules: list[tuple[Column, int, str]], label: int, rule: str) -> Column:
    """The first rule whose condition holds."""
    first, *rest = rules
    out = F.when(F.coalesce(first[0], F.lit(False)), _verdict(*first[1:]))
    for condition, value, name in rest:
        out = out.when(F.coalesce(condition, F.lit(False)), _verdict(value, name))
    return out.otherwise(_verdict(label, rule))


def rubric_label(a: Column, b: Column, cos: Column, lev: Column) -> Column:
    """Label by text cues first, then by the two scores. A null score reaches no threshold."""
    verb_a, verb_b = http_verb(a), http_verb(b)
    size = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return _chain([
        (call_against_callonce(a, b), 0, "R4_call_vs_callonce"),
        (def_against_set(a, b), 0, "R4_def_vs_set"),
        (verb_a != verb_b, 0, "R5_different_http_verbs"),
        (polarity_flip(a, b), 0, "R6_polarity_flip"),
        (presence_against_content(a, b), 0, "R7_presence_vs_content"),
        (action_against_assertion(a, b), 0, "R8_action_vs_assertion"),
        ((cos >= 0.92) & (lev >= 0.80), 1, "R1_parametric_high_cos_high_lev"),
        ((cos >= 0.88) & (lev >= 0.70) & (size >= 0.75), 1, "R1_parametric_high_cos_mid_lev"),
        ((cos >= 0.85) & (lev >= 0.85), 1, "R1_parametric_mid_cos_high_lev"),
        ((cos >= 0.82) & (lev >= 0.65) & (size >= 0.80), 1, "R2_paraphrase_similar_length"),
    ], 0, "R10_default_not_duplicate")


def canonical_tokens(text: Column) -> Column:
    """Words with parameters levelled and each synonym replaced by the first of its family in code-point order."""
    families = [kv for family in SYNONYMS for word in family for kv in (F.lit(word), F.lit(min(family)))]
    lookup = F.create_map(*families)
    return F.transform(words_of(bare_words(text)), lambda w: F.coalesce(F.element_at(lookup, w), w))


def score_free_label(a: Column, b: Column) -> Column:
    """Label by the texts alone."""
    low_a, low_b = F.lower(a), F.lower(b)

    def denies(x: Column) -> Column:
        return F.arrays_overlap(_tokens(x), F.array(F.lit("not"), F.lit("n't")))

    def asserts(x: Column) -> Column:
        return x.startswith("should ") | x.contains(" should ") | x.startswith("the ")

    verb_a, verb_b = (F.coalesce(*(F.when(x.contains(f'"{v}"') | F.concat(F.lit(" "), x, F.lit(" ")).contains(f" {v} "), v) for v in VERBS)) for x in (a, b))
    ca, cb = canonical_tokens(a), canonical_tokens(b)
    shorter, longer = F.least(F.size(ca), F.size(cb)), F.greatest(F.size(ca), F.size(cb))
    ja, jb = F.array_join(ca, " "), F.array_join(cb, " ")
    contained = F.when(F.size(ca) <= F.size(cb), F.contains(jb, ja)).otherwise(F.contains(ja, jb))
    sa, sb = F.array_distinct(ca), F.array_distinct(cb)
    both = F.size(F.array_intersect(sa, sb))
    return _chain([
        (call_against_callonce(low_a, low_b) | def_against_set(a, b), 0, "R4_sf"),
        (verb_a != verb_b, 0, "R5_sf"),
        ((denies(a) != denies(b)) & _within(_differences(a, b), ("not", "n't", "should", "shouldn't")), 0, "R6_sf"),
        (_either(lambda x, y: _has(x, EXISTENCE) & _has(y, CONTENT), low_a, low_b), 0, "R7_sf"),
        (_either(lambda x, y: _starts(x, ACTION_STARTS) & asserts(y) & ~asserts(x), low_a, low_b), 0, "R8_sf"),
        (ca == cb, 1, "P1_sf_exact_after_normalisation"),
        ((F.array_sort(ca) == F.array_sort(cb)) & (F.size(ca) >= 3), 1, "P2_sf_token_multiset"),
        ((shorter >= 3) & contained & (shorter / longer >= 0.70), 1, "P3_sf_subsequence"),
        ((F.size(sa) > 0) & (F.size(sb) > 0) & (both / (F.size(sa) + F.size(sb) - both) >= 0.80), 1, "P4_sf_token_jaccard"),
    ], 0, "R10_sf_default")
