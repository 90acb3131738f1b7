"""Evaluation and calibration: rates, ranks, thresholds, intervals."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfathom.operators.ranks import quantiles, running_sums


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's r of pairs without NULLs; NULL where either does not vary (the built-in raises there in ANSI mode)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = a.isNotNull() & b.isNotNull()
    p, q = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    d = F.stddev_samp(p) * F.stddev_samp(q)
    return F.when(d > 1e-12, F.covar_samp(p, q) / d)


def score_counts(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by, score, pos, neg): the table that every rank statistic is made from; rows become counts before any window."""
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum((1 - F.col(label)).cast("bigint")).alias("neg"))


def auroc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Area under the ROC with ties counted half; NULL where one class is missing."""
    c = running_sums(score_counts(df, score, label, by), by, "s", ["neg"])
    below = F.col("neg_upto") - F.col("neg")
    a = c.groupBy(*by).agg(F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return a.select(*by, F.try_divide(F.col("u"), (F.col("p") * F.col("n")).cast("double")).alias("auroc"), F.col("p").alias("positives"), F.col("n").alias("negatives"))


def threshold_scan(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by, t, pos, neg, tp, fp): counts at and at or above each score."""
    c = running_sums(score_counts(df, score, label, by), by, "s", ["pos", "neg"])
    above = lambda v: F.col(f"{v}_all") - F.col(f"{v}_upto") + F.col(v)
    return c.select(*by, F.col("s").alias("t"), "pos", "neg", above("pos").alias("tp"), above("neg").alias("fp"))


def average_precision(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Average precision over the descending thresholds, and the Brier score."""
    c = threshold_scan(df, score, label, by)
    sq = F.col("pos") * (1 - F.col("t")) * (1 - F.col("t")) + F.col("neg") * F.col("t") * F.col("t")
    return c.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("pos").cast("double")).alias("ap"), (F.sum(sq) / F.sum(F.col("pos") + F.col("neg"))).alias("brier"))


def choose_threshold(df: DataFrame, score: str, label: str, by: list[str], target: float = 0.85, floor: float = 0.3, least: int = 10) -> DataFrame:
    """The lowest threshold (scores to four digits, at or above the floor, with enough flags) that reaches the target precision, else the most precise."""
    scan = threshold_scan(df.withColumn(score, F.bround(score, 4)), score, label, by).where((F.col("t") >= floor) & (F.col("tp") + F.col("fp") >= least))
    p = F.col("tp") / (F.col("tp") + F.col("fp"))
    a = scan.withColumn("precision", p).groupBy(*by).agg(F.min(F.when(F.col("precision") >= target, F.col("t"))).alias("hit"), F.max_by("t", F.struct("precision", -F.col("t"))).alias("best"))
    return a.select(*by, F.coalesce("hit", "best", F.lit(floor)).alias("threshold"))


def tpr_at_fpr(df: DataFrame, score: str, label: str, by: list[str], fpr: float = 0.05) -> DataFrame:
    """Recall at the linear quantile of the negatives."""
    t = quantiles(df.where(F.col(label) == 0), by, score, [1 - fpr]).select(*by, F.col("value").alias("t"))
    return df.where(F.col(label) == 1).join(t, by).groupBy(*by).agg(F.first("t").alias("threshold"), F.avg((F.col(score) >= F.col("t")).cast("double")).alias("tpr"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The 95 % score interval of k of n."""
    p = k / n
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def _beta_tail(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, element by element, for x <= (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    front = np.exp(a * np.log(x) + b * np.log1p(-x) - _lgamma(a) - _lgamma(b) + _lgamma(a + b)) / a
    c, d = np.ones_like(x), 1 / np.maximum(1 - (a + b) * x / (a + 1), tiny)
    h = d.copy()
    for m in range(1, 2000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + t / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return front * h


_lgamma = np.vectorize(math.lgamma, otypes=[float])
#: From this many hits and misses on, the closed form of :func:`cp_upper_values` is exact to 1e-7.
MANY = 5000


def cp_upper_values(k: np.ndarray, n: np.ndarray, alpha: float = 0.05) -> np.ndarray:
    """Exact binomial upper bounds, the p at which k or fewer of n have probability alpha; 1 where n is 0 or k >= n.

    All pairs are solved together by bisection on the incomplete beta function; the work does not grow with k. With many
    hits and many misses a cube-root normal approximation takes its place.
    """
    k, n = np.asarray(k, float), np.asarray(n, float)
    out = np.ones(len(k))
    some = (n > 0) & (k < n) & (k >= 0)
    large = some & (k > MANY) & (n - k > MANY)
    if large.any():
        z, a, b, m = NormalDist().inv_cdf(1 - alpha), k[large] + 1, n[large] - k[large], n[large]
        root = np.sqrt(9 * a * b * (9 * m + 5 - z * z) + m + 1)
        out[large] = 1 / (1 + (a / b) ** 2 * ((81 * a * b - 9 * m - 8 - 3 * z * root) / (81 * a * a - 9 * a * (2 + z * z) + 1)) ** 3)
    small = some & ~large
    if small.any():
        a, b = n[small] - k[small], k[small] + 1
        lo, hi = k[small] / n[small], np.ones(small.sum())
        for _ in range(60):
            p = (lo + hi) / 2
            x = 1 - p
            left = x <= (a + 1) / (a + b + 2)
            tail = np.where(left, _beta_tail(np.where(left, np.maximum(x, 1e-300), 0.5), a, b), 1 - _beta_tail(np.where(left, 0.5, np.maximum(p, 1e-300)), b, a))
            lo, hi = np.where(tail > alpha, p, lo), np.where(tail > alpha, hi, p)
        out[small] = (lo + hi) / 2
    return out


def cp_upper_value(k: int, n: int, alpha: float = 0.05) -> float:
    return float(cp_upper_values(np.array([k]), np.array([n]), alpha)[0])


def cp_upper(alpha: float = 0.05):
    """A17 as a vectorised function of two integer columns."""

    @F.pandas_udf("double")
    def bound(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(cp_upper_values(k.to_numpy(), n.to_numpy(), alpha))

    return bound


def _grid(score: str | Column, up: bool) -> Column:
    """The number of the cut (cuts are 1/10,000 apart) next to a score from below or above, so that score >= cut, or
    score <= cut, holds for the unrounded score exactly when it holds for the numbers."""
    s = F.col(score) if isinstance(score, str) else score
    k = F.round(s * 10000).cast("bigint")
    cut = k / F.lit(10000.0)
    return k + F.when(cut < s, 1).otherwise(0) if up else k - F.when(cut > s, 1).otherwise(0)


def fit_bands(df: DataFrame, score: str, label: str, fpr: float = 0.05, miss: float = 0.10) -> DataFrame:
    """One row with the lowest cut whose false positives, and the highest whose misses, stay within the budgets at the
    exact upper bound (1 and 0 where none does; the human cut never lies above the machine cut), the observed rates, and
    the shares between the cuts.

    Cuts are the scores to four digits, 0 and 1; unrounded scores are counted against them. The tables of cuts have at most
    10,001 rows whatever the input.
    """
    x = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    human, machine = F.col(label) == 0, F.col(label) == 1
    cuts = x.select(F.bround(score, 4).alias("s")).unionAll(df.sparkSession.createDataFrame([(0.0,), (1.0,)], "s double")).select(F.round(F.col("s") * 10000).cast("bigint").alias("g")).distinct()
    at = x.groupBy(_grid(score, False).alias("g")).agg(F.sum(human.cast("bigint")).alias("h")).withColumn("m", F.lit(0)).unionAll(x.groupBy(_grid(score, True).alias("g")).agg(F.sum(machine.cast("bigint")).alias("m")).select("g", F.lit(0), "m"))
    one = W.partitionBy(F.lit(0))
    c = at.unionAll(cuts.select("g", F.lit(0), F.lit(0))).groupBy("g").agg(F.sum("h").alias("h"), F.sum("m").alias("m"))
    c = c.withColumn("fp", F.sum("h").over(one.orderBy(F.desc("g")))).withColumn("fn", F.sum("m").over(one.orderBy("g"))).withColumn("nh", F.sum("h").over(one)).withColumn("nm", F.sum("m").over(one))
    ub = cp_upper()
    c = c.join(cuts, "g", "left_semi").withColumn("ub_fp", ub("fp", "nh")).withColumn("ub_fn", ub("fn", "nm"))
    a = c.agg(F.coalesce(F.min(F.when(F.col("ub_fp") <= fpr, F.col("g"))), F.lit(10000)).alias("gm"), F.coalesce(F.max(F.when(F.col("ub_fn") <= miss, F.col("g"))), F.lit(0)).alias("gh"))
    t = a.select((F.col("gm") / 10000.0).alias("t_machine"), (F.least("gh", "gm") / 10000.0).alias("t_human"))
    s = F.col(score)
    between = (s > F.col("t_human")) & (s < F.col("t_machine"))
    share = lambda hit, of: F.try_divide(F.sum((hit & of).cast("double")), F.sum(of.cast("double")))
    return x.crossJoin(F.broadcast(t)).agg(  # t has one row
        F.first("t_machine").alias("t_machine"), F.first("t_human").alias("t_human"), share(s >= F.col("t_machine"), human).alias("observed_fpr"), share(s <= F.col("t_human"), machine).alias("observed_miss"),
        share(between, human).alias("abstain_human"), share(between, machine).alias("abstain_machine"), F.sum(human.cast("bigint")).alias("n_human"), F.sum(machine.cast("bigint")).alias("n_machine"),
    )


def budget_cut(df: DataFrame, score: str, budget: float, side: str = "above", alpha: float = 0.05) -> DataFrame:
    """(cut, k, n): for ``above`` the lowest cut at which the rows at or above it, for ``below`` the highest at
    which the rows below it, stay within ``budget`` at the exact upper bound. Cuts are the scores to four digits;
    unrounded scores are counted against them."""
    x = df.where(F.col(score).isNotNull())
    cuts = x.select(F.round(F.bround(score, 4) * 10000).cast("bigint").alias("g")).distinct()
    c = x.groupBy(_grid(score, False).alias("g")).agg(F.count("*").alias("c")).unionAll(cuts.select("g", F.lit(0))).groupBy("g").agg(F.sum("c").alias("c"))
    one = W.partitionBy(F.lit(0))
    k = F.sum("c").over(one.orderBy(F.desc("g"))) if side == "above" else F.sum("c").over(one.orderBy("g")) - F.col("c")
    c = c.withColumn("k", k).withColumn("n", F.sum("c").over(one)).join(cuts, "g", "left_semi").withColumn("ub", cp_upper(alpha)("k", "n")).where(F.col("ub") <= budget)
    return c.orderBy("g" if side == "above" else F.desc("g")).limit(1).select((F.col("g") / 10000.0).alias("cut"), "k", "n")


def auroc_resampled(df: DataFrame, score: str, label: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """One row with the AUROC, its bootstrap interval, the 95th percentile under shuffled labels and the p-value.

    Only counts by score (four digits, at most 10,001 rows) reach the driver; a shuffle of the labels is a draw from the
    multivariate hypergeometric distribution of the counts, a resample a multinomial one.
    """
    counts = score_counts(df.withColumn(score, F.bround(score, 4)), score, label, []).orderBy("s").toPandas()
    pos, neg = counts["pos"].to_numpy(np.int64), counts["neg"].to_numpy(np.int64)
    schema = "auroc double, low double, high double, null95 double, p_value double"
    if not pos.sum() or not neg.sum():
        return df.sparkSession.createDataFrame([], schema)

    def area(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        below = np.cumsum(n, axis=-1) - n
        return (p * (below + n / 2)).sum(axis=-1) / (p.sum(axis=-1) * n.sum(axis=-1))

    rng = np.random.default_rng(seed)
    value = float(area(pos, neg))
    boot = area(rng.multinomial(pos.sum(), pos / pos.sum(), draws), rng.multinomial(neg.sum(), neg / neg.sum(), draws))
    shuffled = rng.multivariate_hypergeometric(pos + neg, int(pos.sum()), draws, method="marginals")
    null = area(shuffled, (pos + neg) - shuffled)
    low, high = np.percentile(boot, [2.5, 97.5])
    return df.sparkSession.createDataFrame([(value, float(low), float(high), float(np.percentile(null, 95)), float((1 + (null >= value).sum()) / (1 + draws)))], schema)
