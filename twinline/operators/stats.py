"""Statistics on labelled pairs and on group results."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.operators.profile import average_ranks

SWEEP = (50, 99)
BASELINE_SWEEP = (30, 99)


def confusion(prediction: Column, gold: Column) -> list[Column]:
    """tp, fp, fn, tn as aggregates of two booleans."""
    return [F.count_if(p & g).alias(n) for n, p, g in (("tp", prediction, gold), ("fp", prediction, ~gold), ("fn", ~prediction, gold), ("tn", ~prediction, ~gold))]


def quality(df: DataFrame) -> DataFrame:
    """df with precision, recall and f1 from tp, fp and fn; 0 where a denominator is."""
    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    both = df.withColumn("precision", p).withColumn("recall", r)
    return both.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def sweep(pairs: DataFrame, scores: dict[str, Column], gold: Column, span: tuple[int, int] = SWEEP, where: dict[str, Column] | None = None) -> DataFrame:
    """Quality of ``score >= t`` for each named score and each t in hundredths of span; where adds a condition to a score.

    Pairs are first counted by score, smallest threshold missed and label; so a pair gives one row a score, and
    the thresholds meet at most as many rows as there are thresholds. Null scores reach no threshold, pairs
    without a label don't count.
    """
    lo, hi = span
    where = where or {}
    # The number of thresholds that a score reaches, compared with the same decimal fractions that are reported.
    thresholds = F.sequence(F.lit(lo), F.lit(hi))

    def reached(name: str) -> Column:
        hits = F.size(F.filter(thresholds, lambda t: scores[name] >= t / 100.0))
        return F.when(scores[name].isNotNull() & where.get(name, F.lit(True)), hits).otherwise(0)

    each = pairs.filter(gold.isNotNull()).select(gold.alias("gold"), F.explode(F.array(*(F.struct(F.lit(n).alias("strategy"), reached(n).alias("k")) for n in scores))).alias("x")).select("gold", "x.*")
    counted = each.groupBy("strategy", "k").agg(F.count_if("gold").alias("g"), F.count_if(~F.col("gold")).alias("o"))
    spread = counted.select("strategy", "k", "g", "o", F.posexplode(thresholds).alias("i", "t"))
    hit = F.col("k") > F.col("i")
    totals = spread.groupBy("strategy", "t").agg(*(F.sum(F.when(h, F.col(c)).otherwise(0)).alias(n) for n, h, c in (("tp", hit, "g"), ("fp", hit, "o"), ("fn", ~hit, "g"), ("tn", ~hit, "o"))))
    return quality(totals.withColumn("threshold", F.col("t") / 100.0).drop("t"))


def best(swept: DataFrame, rounded: bool = False) -> DataFrame:
    """The row with the best f1 of each strategy, then the best precision, then the smallest threshold; rounded compares 4 decimals."""
    f1, precision = (F.round(c, 4) if rounded else F.col(c) for c in ("f1", "precision"))
    row = F.max_by(F.struct(*[c for c in swept.columns if c != "strategy"]), F.struct(f1, precision, -F.col("threshold")))
    return swept.groupBy("strategy").agg(row.alias("x")).select("strategy", "x.*")


def best_in_order(swept: DataFrame) -> DataFrame:
    """The best row of each strategy if thresholds are walked upwards and a row wins whose f1 exceeds the incumbent's rounded one.

    So an equal f1 wins later on, if the incumbent's was rounded down.
    """
    cols = [c for c in swept.columns if c != "strategy"]
    ordered = swept.groupBy("strategy").agg(F.array_sort(F.collect_list(F.struct("threshold", *[c for c in cols if c != "threshold"]))).alias("rows"))  # a row a threshold
    won = F.reduce("rows", F.get("rows", F.lit(0)), lambda a, r: F.when(r["f1"] > F.round(a["f1"], 4), r).otherwise(a))
    return ordered.select("strategy", won.alias("x")).select("strategy", "x.*")


def _landis(kappa: Column) -> Column:
    return F.when(kappa < 0.20, "slight").when(kappa < 0.40, "fair").when(kappa < 0.60, "moderate").when(kappa < 0.80, "substantial").otherwise("almost perfect")


def cohen_kappa(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Agreement of two binary ratings; rows that lack either don't count."""
    x, y = a.cast("double"), b.cast("double")
    s = rows.filter(a.isNotNull() & b.isNotNull()).agg(F.count("*").alias("n"), F.count_if(a == b).alias("n_agree"), F.avg(x).alias("p"), F.avg(y).alias("q"))
    expected = F.col("p") * F.col("q") + (1 - F.col("p")) * (1 - F.col("q"))
    s = s.withColumn("observed", F.col("n_agree") / F.col("n")).withColumn("expected", expected)
    s = s.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).otherwise(1.0))
    return s.select("n", "n_agree", "observed", "expected", "kappa", _landis(F.col("kappa")).alias("reading"))


def fleiss_kappa(rows: DataFrame, raters: list[str]) -> DataFrame:
    """Agreement of several binary raters; rows that lack any rating don't count."""
    k = len(raters)
    ones = sum((F.col(r).cast("double") for r in raters), F.lit(0.0))
    agree = (ones * (ones - 1) + (k - ones) * (k - ones - 1)) / (k * (k - 1))
    s = rows.dropna(subset=raters).agg(F.count("*").alias("n"), F.avg(agree).alias("observed"), F.avg(ones / k).alias("p"), F.count_if((ones == 0) | (ones == k)).alias("n_unanimous"))
    s = s.withColumn("expected", F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p")))
    kappa = F.when(F.col("expected") >= 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    return s.select("n", "n_unanimous", "observed", "expected", kappa.alias("kappa"))


def bootstrap(pairs: DataFrame, key: Column, predictions: dict[str, Column], gold: Column, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """(strategy, metric, mean, lo, hi): 95 % intervals of precision, recall and F1 by the Poisson bootstrap.

    Each pair weighs in each replicate as a Poisson(1) draw that depends on seed, key and replicate only, so the
    result doesn't depend on partitions. Workers add up confusion counts per replicate; n_boot rows a strategy
    and partition are shuffled, whatever the number of pairs. The intervals agree with resampling in
    distribution, not draw by draw.
    """
    names = list(predictions)
    rows = pairs.filter(gold.isNotNull()).select(F.xxhash64(F.lit(seed), key).alias("h"), gold.cast("int").alias("g"), *(F.coalesce(p, F.lit(False)).cast("int").alias(f"p{i}") for i, p in enumerate(predictions.values())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((n_boot, len(names), 3))
        for pdf in batches:
            for a in range(0, len(pdf), 1024):
                part = pdf.iloc[a : a + 1024]
                draws = np.stack([np.random.Generator(np.random.Philox(key=int(h) & (2**63 - 1))).poisson(1, n_boot) for h in part["h"]])
                g = part["g"].to_numpy()
                for i in range(len(names)):
                    p = part[f"p{i}"].to_numpy()
                    sums[:, i] += draws.T @ np.column_stack([p & g, p & (1 - g), (1 - p) & g])
        yield pd.DataFrame([(r, names[i], *sums[r, i]) for r in range(n_boot) for i in range(len(names))], columns=["rep", "strategy", "tp", "fp", "fn"])

    counts = rows.mapInPandas(run, "rep int, strategy string, tp double, fp double, fn double").groupBy("rep", "strategy").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    metrics = quality(counts).select("strategy", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("precision", "recall", "f1")))))
    return metrics.groupBy("strategy", "metric").agg(F.avg("value").alias("mean"), F.expr("percentile(value, 0.025)").alias("lo"), F.expr("percentile(value, 0.975)").alias("hi"))


def _upper_gamma(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function: the series below x = s + 1, a continued fraction beyond."""
    if x <= 0:
        return 1.0
    scale = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        k = s
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - scale * total
    value = 0.0
    for n in range(500, 0, -1):  # from the innermost fraction outwards
        value = n * (n - s) / (x + 2 * n + 1 - s - value)
    return scale / (x + 1 - s - value)


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction from the innermost term outwards."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    value = 1.0
    for n in range(500, 0, -1):
        m, odd = divmod(n, 2)
        d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) if odd else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1 + d / value
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / (a * value)


def chi_square(groups: DataFrame, group: str, base: str) -> DataFrame:
    """One row per test from rows (group, n_steps, n_unique): chi-square of duplicates against uniques over all groups, and each group against base.

    z and h use rates rounded to 4 decimals. Groups are few; the closed forms run on the driver.
    """
    rows = {r[group]: (r["n_steps"], r["n_unique"]) for r in groups.select(group, "n_steps", "n_unique").collect()}
    table = np.array([[n - u, u] for n, u in rows.values()], float).reshape(-1, 2)
    grand = table.sum()
    expected = np.outer(table.sum(1), table.sum(0)) / max(grand, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = float(np.nansum((table - expected) ** 2 / expected))
    df = max(len(rows) - 1, 0)
    out = [("all", chi2, float(df), _upper_gamma(df / 2, chi2 / 2) if df else 1.0, math.sqrt(chi2 / grand) if grand else 0.0)]
    rate = {g: round(1 - u / max(n, 1), 4) for g, (n, u) in rows.items()}
    for g in sorted(set(rows) - {base}) if base in rows else ():
        p1, n1, p2, n2 = rate[base], rows[base][0], rate[g], rows[g][0]
        pooled = (p1 * n1 + p2 * n2) / (n1 + n2)
        se = math.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
        z = (p1 - p2) / se if se else 0.0
        out.append((f"{base}_vs_{g}", z, None, math.erfc(abs(z) / math.sqrt(2)), abs(2 * math.asin(math.sqrt(p1)) - 2 * math.asin(math.sqrt(p2)))))
    return groups.sparkSession.createDataFrame(out, "test string, statistic double, df double, p_value double, effect double")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho): Pearson's correlation of averaged ranks; 0 without variation."""
    ranked = average_ranks(average_ranks(rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "rx"), y, "ry")
    return ranked.agg(F.count("*").alias("n"), F.coalesce(F.corr("rx", "ry"), F.lit(0.0)).alias("rho"))


def spearman_p(n: int, rho: float) -> float:
    """Two-sided p-value of a rank correlation by Student's t."""
    if n <= 2 or abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / max(1 - rho * rho, 1e-12)
    return _beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def tfidf_cosine(pairs: DataFrame, id_: str, a: str, b: str, sizes: tuple[int, int] = (3, 5)) -> DataFrame:
    """(id, cos) by character n-grams within words, sublinear counts, smoothed inverse document frequency, length one.

    Both sides of all pairs are the documents of the statistics.
    """
    sides = pairs.select(F.col(id_).alias("id"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(a).alias("t")), F.struct(F.lit(1).alias("side"), F.col(b).alias("t")))).alias("x")).select("id", "x.*").filter("t IS NOT NULL")
    n = sides.count()
    words = F.filter(F.split(F.lower("t"), r"(?U)\s+"), lambda w: w != "")
    word = sides.select("id", "side", F.explode(words).alias("w")).select("id", "side", F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    lo, hi = sizes
    # A word no longer than a size is one gram, once, and has none of the larger sizes.
    size = F.explode(F.filter(F.sequence(F.lit(lo), F.lit(hi)), lambda k: (k == lo) | (k <= F.length("w"))))
    spot = F.explode(F.sequence(F.lit(1), F.greatest(F.length("w") - F.col("k") + 1, F.lit(1))))
    grams = word.select("id", "side", "w", size.alias("k")).select("id", "side", "w", "k", spot.alias("i")).select("id", "side", F.substr("w", F.col("i"), F.col("k")).alias("g"))
    tf = grams.groupBy("id", "side", "g").agg((1 + F.log(F.count("*"))).alias("tf"))
    df = tf.groupBy("g").agg(F.count("*").alias("df")).select("g", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf"))
    both = tf.join(df, "g").groupBy("id", "g").agg(*(F.coalesce(F.max(F.when(F.col("side") == s, F.col("tf") * F.col("idf"))), F.lit(0.0)).alias(c) for s, c in ((0, "x"), (1, "y"))))
    sums = both.groupBy("id").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    scored = sums.select("id", F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(0.0).alias("cos"))
    return pairs.select(F.col(id_).alias("id")).join(scored, "id", "left").select("id", F.coalesce("cos", F.lit(0.0)).alias("cos"))
