import math

import pytest
from pyspark.sql import functions as F

from twinline.functions import rules
from twinline.operators import pairs, sampling, stats


def label(rows, f, a, b, cos=0.0, lev=0.0):
    df = rows([(a, b, cos, lev)], "a string, b string, c double, l double")
    args = [F.col(x) for x in "abcl"]
    return tuple(df.select(f(*args).alias("x")).first().x)


@pytest.mark.parametrize(("a", "b", "cos", "lev", "rule"), [
    ("call read('x')", "callonce read('x')", 0.99, 0.99, "R4_call_vs_callonce"),
    ("def a = 1", "set a = 1", 0.99, 0.99, "R4_def_vs_set"),
    ('I send "GET" to x', "I send a POST request", 0.99, 0.9, "R5_different_http_verbs"),
    ("it should not pass", "it should pass", 0.99, 0.9, "R6_polarity_flip"),
    ("a b c", "c b a", 0.99, 0.9, "R6_polarity_flip"),  # no difference in words counts as one of negation
    ("the file should exist", "the content of the file equals x", 0.99, 0.9, "R7_presence_vs_content"),
    ("I click save now", "it should save at once", 0.99, 0.9, "R8_action_vs_assertion"),
    ("open page one", "open page two", 0.93, 0.85, "R1_parametric_high_cos_high_lev"),
    ("open page one", "open page two", 0.89, 0.72, "R1_parametric_high_cos_mid_lev"),
    ("open page one", "open page two and a lot more", 0.86, 0.86, "R1_parametric_mid_cos_high_lev"),
    ("open page one", "open page two", 0.83, 0.66, "R2_paraphrase_similar_length"),
    ("open page one", "open page two", None, None, "R10_default_not_duplicate"),
])
def test_rubric(rows, a, b, cos, lev, rule):
    got = label(rows, rules.rubric_label, a, b, cos, lev)
    assert got == (int(rule[:2] in ("R1", "R2") and not rule.startswith("R10")), rule)


@pytest.mark.parametrize(("a", "b", "rule"), [
    ("call x", "callonce x", "R4_sf"), ('"GET" it', '"PUT" it', "R5_sf"), ("it is not here", "it is here", "R6_sf"),
    ("x should exist", "x should be y", "R7_sf"), ("click it", "the page should open", "R8_sf"),
    ('I see "a" 12', 'I view "b" 7', "P1_sf_exact_after_normalisation"), ("first then second", "second then first", "P2_sf_token_multiset"),
    ("one two three", "one two three four", "P3_sf_subsequence"), ("a1 b c d e f g h i j", "b a1 c d e f g h j k i", "P4_sf_token_jaccard"), ("alpha beta", "gamma delta", "R10_sf_default"),
])
def test_score_free(rows, a, b, rule):
    got = label(rows, lambda x, y, *_: rules.score_free_label(x, y), a, b)
    assert got == (int(rule[0] == "P"), rule)


def test_synonyms(rows):
    df = rows([("I fetch the 200 OK == response",)], "t string")
    assert df.select(rules.canonical_tokens(F.col("t"))).first()[0] == ["i", "fetch", "a", "param", "200", "response"]


PAIRS = [(i, i / 40, 1 - i / 50, int(i % 3 == 0 or i > 25)) for i in range(40)] + [(40, None, 0.9, 1), (41, 0.9, 0.9, None)]


def test_sweep_and_best(rows):
    df = rows(PAIRS, "id long, cos double, lev double, label int")
    got = {(r.strategy, r.threshold): r for r in stats.sweep(df, {"s": F.col("cos"), "h": F.col("cos")}, F.col("label") == 1, where={"h": F.col("lev") >= 0.4}).collect()}
    assert len(got) == 100
    for (name, t), r in got.items():
        hit = [(c is not None and c >= t and (name == "s" or lev >= 0.4), g) for _, c, lev, g in PAIRS if g is not None]
        assert (r.tp, r.fp, r.fn, r.tn) == tuple(sum(1 for x in hit if x == y) for y in ((True, 1), (True, 0), (False, 1), (False, 0)))
    swept = stats.sweep(df, {"s": F.col("cos")}, F.col("label") == 1)
    best = stats.best(swept).first()
    top = max((r.f1, r.precision, -r.threshold) for r in swept.collect())
    assert (best.f1, best.precision, -best.threshold) == top
    # Walking upwards, an equal f1 wins where the incumbent's was rounded down.
    rising = rows([("s", t, f, 0.5, 0.5, 1, 1, 1, 1) for t, f in ((0.5, 0.33333), (0.6, 0.33333), (0.7, 0.2))], "strategy string, threshold double, f1 double, precision double, recall double, tp long, fp long, fn long, tn long")
    assert stats.best_in_order(rising).first().threshold == 0.6
    assert stats.best(rising).first().threshold == 0.5


def test_kappas(rows):
    df = rows([(1, 1, 1), (1, 1, 0), (0, 0, 0), (0, 1, 0), (1, None, 1)], "a int, b int, c int")
    c = stats.cohen_kappa(df, F.col("a"), F.col("b")).first()
    assert (c.n, c.n_agree, c.observed, c.expected) == (4, 3, 0.75, 0.5) and c.kappa == pytest.approx(0.5) and c.reading == "moderate"
    f = stats.fleiss_kappa(df, ["a", "b", "c"]).first()
    assert (f.n, f.n_unanimous) == (4, 2) and f.observed == pytest.approx(2 / 3) and f.kappa == pytest.approx(1 / 3)
    assert stats.fleiss_kappa(df.filter("a = 1 AND c = 1 AND b = 1"), ["a", "b", "c"]).first().kappa == 1.0


def test_chi_square(rows):
    df = rows([("permissive", 1000, 200), ("copyleft", 800, 240), ("unknown", 500, 150)], "license_class string, n_steps long, n_unique long")
    r = {x.test: x for x in stats.chi_square(df, "license_class", "permissive").collect()}
    dup, uni = [800, 560, 350], [200, 240, 150]
    chi = sum((o - n * t / 2300) ** 2 / (n * t / 2300) for row, t in ((dup, 1710), (uni, 590)) for o, n in zip(row, (1000, 800, 500), strict=True))
    assert r["all"].statistic == pytest.approx(chi) and r["all"].df == 2 and r["all"].p_value == pytest.approx(math.exp(-chi / 2), rel=1e-6)
    assert r["permissive_vs_copyleft"].effect == pytest.approx(abs(2 * math.asin(math.sqrt(0.8)) - 2 * math.asin(math.sqrt(0.7))))


def test_special_functions():
    assert stats._upper_gamma(1.5, 3.0) == pytest.approx(math.erfc(math.sqrt(3)) + math.sqrt(12 / math.pi) * math.exp(-3), rel=1e-9)
    assert stats._upper_gamma(1.5, 0.3) == pytest.approx(math.erfc(math.sqrt(0.3)) + math.sqrt(4 * 0.3 / math.pi) * math.exp(-0.3), rel=1e-9)
    assert stats._beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)
    assert stats._beta(0.5, 0.5, 0.25) == pytest.approx(2 / math.pi * math.asin(0.5), rel=1e-9)
    assert stats.spearman_p(347, 0.5079) == pytest.approx(3.699e-24, rel=0.01)


def test_spearman(rows):
    df = rows([(1, 2.0), (2, 1.0), (2, 3.0), (4, 4.0), (None, 1.0)], "x int, y double")
    r = stats.spearman(df, "x", "y").first()
    assert r.n == 4 and r.rho == pytest.approx(0.6324555)


def test_bootstrap_intervals_hold_the_estimate(rows):
    df = rows([(i, int(i % 4 == 0), int(i % 5 == 0)) for i in range(400)], "id long, p int, g int")
    got = {r.metric: r for r in stats.bootstrap(df, F.col("id"), {"s": F.col("p") == 1}, F.col("g") == 1, 300).collect()}
    for name, value in (("precision", 0.2), ("recall", 0.25)):
        r = got[name]
        assert r.lo < value < r.hi and abs(r["mean"] - value) < 0.02 and r.hi - r.lo < 0.25
    again = stats.bootstrap(df.repartition(3), F.col("id"), {"s": F.col("p") == 1}, F.col("g") == 1, 300).collect()
    assert sorted(map(str, again)) == sorted(map(str, got.values()))


def test_tfidf_against_plain_python(rows):
    data = [(1, "the user logs in", "the user logs out"), (2, "ab", "ab"), (3, "", "x"), (4, "save saves", "a saver")]

    def grams(t):
        out = []
        for w in t.lower().split():
            w = f" {w} "
            for n in (3, 4, 5):
                if len(w) >= n or n == 3:
                    out += [w[i : i + n] for i in range(max(len(w) - n + 1, 1))]
        return out

    docs = [grams(t) for _, a, b in data for t in (a, b)]
    df = {g: sum(g in d for d in docs) for d in docs for g in d}
    vec = [{g: (1 + math.log(d.count(g))) * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g in set(d)} for d in docs]

    def cos(x, y):
        n = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y.get(g, 0) for g, v in x.items()) / n if n else 0.0

    got = dict(stats.tfidf_cosine(rows(data, "id long, a string, b string"), "id", "a", "b").collect())
    assert got == pytest.approx({i: cos(vec[2 * k], vec[2 * k + 1]) for k, (i, _, _) in enumerate(data)})


def test_bands_and_sampling(rows):
    df = rows([(c,) for c in (0.49, 0.5, 0.7, 0.95, 1.0, 1.0001, None)], "c double")
    assert [r[0] for r in df.select(pairs.band_of(F.col("c"))).collect()] == [None, "[0.50,0.70)", "[0.70,0.80)", "[0.95,1.00]", "[0.95,1.00]", None, None]
    assert df.select(pairs.band_of(F.col("c"), 1.01, closed=False)).collect()[5][0] == "[0.95,1.01)"
    many = rows([(i, i % 3 if i % 7 else None) for i in range(200)], "id long, s int")
    picked = sampling.per_stratum(many, "s", 5, [F.col("id")])
    assert {r[0]: r[1] for r in picked.groupBy("s").count().collect()} == {0: 5, 1: 5, 2: 5}
    assert sorted(picked.collect()) == sorted(sampling.per_stratum(many.repartition(5), "s", 5, [F.col("id")]).collect())
    texts = rows([(f"open page {i} of the shop",) for i in range(40)] + [(None,)], "text string")
    got = sampling.sample_pairs(texts, per_band=4)
    assert got.count() > 0 and got.groupBy("cos_band").count().filter("count > 4").count() == 0
