"""Probes and controls: thresholds of gates and arms, rank correlations, slopes, collinearity, quotas and plans."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfathom.operators import metrics
from inkfathom.operators.ranks import quantiles, row_numbers
from inkfathom.session import cut_lineage


def gate_threshold(df: DataFrame, gate: str, label: str, budget: float, gap: float = 0.10) -> DataFrame:
    """(cut, k, n, vetoed): the highest cut whose refusals stay within the budget; vetoed where it refuses the two
    authorships at rates further apart than ``gap``."""
    t = metrics.budget_cut(df, gate, budget, "below")
    refused = lambda y: F.avg(F.when(F.col(label) == y, (F.col(gate) < F.col("cut")).cast("double")))
    return df.crossJoin(F.broadcast(t)).groupBy("cut", "k", "n").agg((F.abs(refused(0) - refused(1)) > gap).alias("vetoed"))  # t has one row


def arms_at_budget(df: DataFrame, arms: list[str], label: str, budget: float) -> DataFrame:
    """(arm, cut, recall) of detectors whose cuts all spend the same budget of false alarms."""
    out = None
    for a in arms:
        t = metrics.budget_cut(df.where(F.col(label) == 0), a, budget).select("cut")
        part = df.where(F.col(label) == 1).crossJoin(F.broadcast(t)).groupBy("cut").agg(F.avg((F.col(a) >= F.col("cut")).cast("double")).alias("recall")).select(F.lit(a).alias("arm"), "cut", "recall")  # t has one row
        out = part if out is None else out.unionByName(part)
    return out


def _ranked(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, a, b)
    x = row_numbers(x, [F.col(a), F.col(key)], [], "ra")
    return row_numbers(x, [F.col(b), F.col(key)], [], "rb")


def ordinal_correlation(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """(rho, n): correlation of ordinal ranks, ties in the order of ``key``; ranks come from a global sort, not from one
    window over all rows."""
    return _ranked(df, a, b, key).agg(F.corr("ra", "rb").alias("rho"), F.count("*").alias("n"))


#: Up to this many rows permutations are drawn; beyond, the normal limit of the statistic is exact to its fourth digit.
PERMUTED_ROWS = 20_000


def permutation_p(df: DataFrame, a: str, b: str, key: str, draws: int = 5000, seed: int = 0) -> DataFrame:
    """(rho, p_value), two-sided, (1 + hits) / (1 + draws) under permutations of one side's ranks."""
    r = cut_lineage(_ranked(df, a, b, key).select("ra", "rb"))
    rho, n = r.agg(F.corr("ra", "rb"), F.count("*")).first()
    spark = df.sparkSession
    if rho is None or n < 3:
        return spark.createDataFrame([], "rho double, p_value double")
    if n > PERMUTED_ROWS:
        return spark.createDataFrame([(rho, math.erfc(abs(rho) * math.sqrt(n - 1) / math.sqrt(2)))], "rho double, p_value double")
    x = np.arange(n, dtype=float) - (n - 1) / 2  # ranks are a permutation of 1..n on both sides
    rng = np.random.default_rng(seed)
    hits = sum(abs(float(x @ rng.permutation(x))) / float(x @ x) >= abs(rho) - 1e-12 for _ in range(draws))
    return spark.createDataFrame([(rho, (1 + hits) / (1 + draws))], "rho double, p_value double")


def slopes_and_transplants(df: DataFrame, donor: DataFrame, names: list[str], against: str, gate: Callable[[], Column], cut: float) -> DataFrame:
    """(feature, slope, r, refused): least-squares slope and correlation of each feature on ``against``, and the share a
    gate refuses once the feature's values are replaced by the donor's mean."""
    means = donor.agg(*(F.avg(n).alias(f"_m_{n}") for n in names))  # one row
    x = df.crossJoin(F.broadcast(means))
    out = None
    for n in names:
        swapped = x.withColumn("_own", F.col(n)).withColumn(n, F.col(f"_m_{n}"))
        part = swapped.agg(F.regr_slope("_own", against).alias("slope"), metrics.correlation("_own", against).alias("r"), F.avg((gate() < cut).cast("double")).alias("refused")).select(F.lit(n).alias("feature"), "slope", "r", "refused")
        out = part if out is None else out.unionByName(part)
    return out


def collinearity(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, r2): how much of each feature a regression on the others explains: 1 - 1 / (C^-1)_ii of the correlation
    matrix, which one aggregation gives whatever the number of rows. NULL for features that do not vary."""
    both = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    x = df.where(" AND ".join(f"`{n}` IS NOT NULL" for n in names))
    row = x.agg(*(metrics.correlation(a, b).alias(f"c{i}") for i, (a, b) in enumerate(both))).first()
    c = np.eye(len(names))
    for i, (a, b) in enumerate(both):
        v = row[i] if row[i] is not None else np.nan
        c[names.index(a), names.index(b)] = c[names.index(b), names.index(a)] = v
    flat = [n for k, n in enumerate(names) if len(names) > 1 and np.isnan(np.delete(c[k], k)).all()]
    kept = [k for k, n in enumerate(names) if n not in flat]
    inverse = np.diag(np.linalg.pinv(c[np.ix_(kept, kept)]))
    r2 = {names[k]: float(1 - 1 / v) if v > 1e-12 else None for k, v in zip(kept, inverse, strict=True)}
    return df.sparkSession.createDataFrame([(n, r2.get(n)) for n in names], "feature string, r2 double")


def mcnemar(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """(b, c, p_value): rows that only the first or only the second gets right, and the exact two-sided p-value."""
    b, c = df.agg(F.sum((first & ~second).cast("bigint")), F.sum((~first & second).cast("bigint"))).first()
    b, c = b or 0, c or 0
    n, k = b + c, min(b, c)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]) if n <= 100_000 else None
    p = 1.0 if not n else min(1.0, 2 * float(np.exp(logs).sum())) if logs is not None else math.erfc((abs(b - c) - 1) / math.sqrt(2 * n))
    return df.sparkSession.createDataFrame([(b, c, p)], "b bigint, c bigint, p_value double")


def ranked_failures(df: DataFrame, score: str, label: str, words: str, most: int) -> DataFrame:
    """The ``most`` wrong documents by severity (error times confidence), then by the margin of the logit, then
    the shortest first."""
    p, eps = F.col(score), F.lit(1e-6)
    inside = F.least(F.greatest(p, eps), F.lit(1 - 1e-6))
    x = df.where((p >= 0.5) != (F.col(label) == 1)).select("doc_id", F.abs(p - F.col(label)).alias("error"), F.abs(2 * p - 1).alias("confidence"), F.abs(F.log(inside / (1 - inside))).alias("margin"), F.col(words).alias("words"))
    x = x.withColumn("severity", F.col("error") * F.col("confidence"))
    return x.orderBy(F.desc(F.round("severity", 9)), F.desc(F.round("margin", 9)), F.asc_nulls_last("words"), "doc_id").limit(most)


def consistency(df: DataFrame, feature: str, observer: str, value: str, alarm: float = 1.0) -> DataFrame:
    """(feature, gap, spread, alarm): the largest gap between observers' medians against the spread of all values."""
    middle = quantiles(df, [feature, observer], value, [0.5])
    gap = middle.groupBy(feature).agg((F.max("value") - F.min("value")).alias("gap"))
    spread = df.groupBy(feature).agg(F.stddev_pop(value).alias("spread"))
    return gap.join(spread, feature).withColumn("alarm", F.try_divide(F.col("gap"), F.col("spread")) > alarm)


def boundary_rates(df: DataFrame, key: str, order: str, score: str, label: str, q: float) -> DataFrame:
    """(threshold, false_boundary_rate, adjacent_rate): the quantile of the human documents' largest scores, how often
    human sentences reach it, and how often a sentence that reaches it follows another that does."""
    top = df.where(F.col(label) == 0).groupBy(key).agg(F.max(score).alias("top"))
    t = quantiles(top, [], "top", [q]).select(F.col("value").alias("threshold"))
    x = df.crossJoin(F.broadcast(t)).withColumn("hit", F.col(score) >= F.col("threshold"))  # t has one row
    x = x.withColumn("before", F.lag("hit").over(W.partitionBy(key).orderBy(order)))
    n = lambda c: F.sum(c.cast("double"))
    return x.agg(F.first("threshold").alias("threshold"), F.avg(F.when(F.col(label) == 0, F.col("hit").cast("double"))).alias("false_boundary_rate"), F.try_divide(n(F.col("hit") & F.col("before")), n(F.col("hit"))).alias("adjacent_rate"))


# Sentences in the pool, sentences of an essay, and the most essays that are added to it.
POOL_HUMAN, POOL_MACHINE, PER_ESSAY, CAP = 3544, 469, 19.5, 135


def training_prior(n: Column) -> Column:
    """Share of machine sentences once at most ``CAP`` of n essays join the pool."""
    machine = POOL_MACHINE + PER_ESSAY * F.least(n, F.lit(CAP))
    return machine / (POOL_HUMAN + machine)


def sign_agreement(weights: DataFrame, expected: DataFrame) -> DataFrame:
    """(agree, opposite, no_prior) of the signs of weights (name, coef) against expected ones (name, expected)."""
    x = weights.join(expected, "name")
    same, known = F.signum("coef") == F.col("expected"), F.col("expected") != 0
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return x.agg(n(known & same).alias("agree"), n(known & ~same).alias("opposite"), n(~known).alias("no_prior"))


def fold_differences(df: DataFrame, a: str, b: str, label: str, fold: str) -> DataFrame:
    """(fold, difference) of two scores' areas under the curve in each fold."""
    of = lambda c: metrics.auroc(df, c, label, [fold]).select(fold, F.col("auroc").alias(c))
    return of(a).join(of(b), fold).select(fold, (F.col(a) - F.col(b)).alias("difference"))


def quota_allocation(pools: DataFrame, name: str, size: str, cap: int, held_out: float) -> DataFrame:
    """K4: (name, n, given): smallest pool first, each gets its share of what is left of the cap, but leaves ``held_out`` of
    itself. Pools are few rows, counted before."""
    rows = pools.select(name, size).orderBy(size, name).collect()
    left, out = cap, []
    for i, (k, n) in enumerate(rows):
        given = min(left // (len(rows) - i), int(n * (1 - held_out)))
        left -= given
        out.append((k, n, given))
    return pools.sparkSession.createDataFrame(out, f"`{name}` string, n bigint, given bigint")


def smallest_within_one_error(df: DataFrame, k: str, score: str, label: str) -> DataFrame:
    """K6: (k, hit, chosen): share of machine documents at or above the 95th percentile of the human ones for each number of
    features, and the smallest number within one standard error of the best."""
    t = quantiles(df.where(F.col(label) == 0), [k], score, [0.95]).select(F.col(k).alias("_k"), F.col("value").alias("_t"))
    h = df.where(F.col(label) == 1).join(F.broadcast(t), F.col(k) == F.col("_k")).groupBy(k).agg(F.avg((F.col(score) >= F.col("_t")).cast("double")).alias("hit"), F.count("*").alias("n"))  # one row per k
    best = h.agg(F.max("hit").alias("top"), F.max("n").alias("m"))
    se = F.sqrt(F.greatest(F.col("top") * (1 - F.col("top")), F.lit(1e-9)) / F.greatest("m", F.lit(1)))
    ok = h.crossJoin(F.broadcast(best)).where(F.col("hit") >= F.col("top") - se).agg(F.min(k).alias("first"))
    return h.crossJoin(F.broadcast(ok)).select(k, "hit", (F.col(k) == F.col("first")).alias("chosen"))  # one row


# The bands of essay lengths (share up to, shortest, width), the overshoot of a generator and the floor.
BANDS = ((0.14, 420, 126), (0.36, 546, 67), (0.52, 613, 37), (0.64, 650, 1), (0.90, 651, 100), (1.01, 751, 130))
OVERSHOOT, SHORTEST = 1.068, 400


def uniform(salt: str, key: Column) -> Column:
    """A uniform number in [0, 1) from 32 bits of a salted hash."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt + ":"), key.cast("string")), 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def sampled_length(u: Column, v: Column) -> Column:
    """K9: words to ask for: a band by ``u``, a place in it by ``v``, less the generator's overshoot."""
    want = None
    for top, low, width in BANDS:
        value = F.lit(low) + F.floor(v * width)
        want = F.when(u < top, value) if want is None else want.when(u < top, value)
    return F.greatest(F.lit(SHORTEST), F.bround(want / F.lit(OVERSHOOT), 0).cast("int"))


def generation_plan(subjects: DataFrame, name: str, frames: int = 5, prompts: int = 7, models: int = 4, batch: int = 25, train: float = 0.6) -> DataFrame:
    """K8: one row per subject and frame: split by subject, prompts and models in turn, lengths by K9, batches within models.
    Orders come from salted hashes, so the plan is the same on every run. Numbers come from global sorts."""
    s = subjects.where(F.col(name).isNotNull()).select(name).distinct()
    h = lambda salt, c: F.sha2(F.concat(F.lit(salt + ":"), F.col(c).cast("string")), 256)
    s = row_numbers(row_numbers(s, [h("subject", name), F.col(name)], [], "place"), [F.col(name)], [], "si")
    n = s.agg(F.bround(F.count("*") * F.lit(train), 0).alias("cut"))
    r = s.crossJoin(F.broadcast(n)).select(F.col(name).alias("subject"), F.when(F.col("place") - 1 < F.col("cut"), "train").otherwise("heldout").alias("split"), "si", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame"))  # n is one row
    r = r.withColumn("idx", (F.col("si") - 1) * frames + F.col("frame"))
    r = r.select("idx", "subject", "frame", "split", (F.col("idx") % prompts).cast("int").alias("prompt"), (F.col("idx") % models).cast("int").alias("model"), sampled_length(uniform("u", F.col("idx")), uniform("v", F.col("idx"))).alias("target_words"))
    return row_numbers(r, [h("order", "idx"), F.col("idx")], ["model"], "_n").withColumn("batch", F.floor((F.col("_n") - 1) / batch).cast("int")).drop("_n")


def budgeted_run(df: DataFrame, by: str, order: list[str], estimate: str, cost: str, planned: float, budget: float) -> DataFrame:
    """``df`` with ``outcome``: a run whose estimates exceed ``planned`` is refused before it starts; otherwise calls
    go through in order until those before them have cost ``budget``, and the rest is stopped."""
    w = W.partitionBy(by)
    spent = F.coalesce(F.sum(cost).over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    x = df.withColumn("_planned", F.sum(estimate).over(w)).withColumn("_spent", spent)
    return x.withColumn("outcome", F.when(F.col("_planned") > planned, "refused").when(F.col("_spent") < budget, "done").otherwise("stopped")).drop("_planned", "_spent")
