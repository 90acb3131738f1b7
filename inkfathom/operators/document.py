"""From sentence verdicts to passages and document verdicts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfathom.operators.runs import map_runs

# The limits and thresholds of the served build.
MAX_WORDS, MIN_TOKENS, PASSAGE_THRESHOLD, FLAG_THRESHOLD = 90, 5, 0.65, 0.3004
BANDS = {"t_human": 0.0598, "t_machine": 0.8948}


def _order():
    return W.partitionBy("doc_id").orderBy("sentence_index")


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """One row per (doc_id, sentence_index): the last scoring; NaN becomes NULL."""
    w = W.partitionBy("doc_id", "sentence_index").orderBy(F.desc("scored_at"), F.desc_nulls_last("probability"), "char_start", "char_end", F.desc_nulls_last("smoothed"), F.desc_nulls_last("n_words"))
    nan = F.lit(float("nan"))
    v = verdicts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return v.withColumns({"probability": F.nullif("probability", nan), "smoothed": F.nullif("smoothed", nan)})


def smoothed(v: DataFrame) -> DataFrame:
    """Word-weighted mean over a sentence and its neighbours, itself twice; an unreliable one keeps its own value."""
    w = F.when(F.col("reliable"), F.col("n_words").cast("double")).otherwise(0.0)
    w = F.coalesce(w, F.lit(0.0))
    p = F.coalesce("probability", F.lit(0.0))
    v = v.withColumn("_w", F.when(F.col("probability").isNull(), 0.0).otherwise(w)).withColumn("_pw", p * F.col("_w"))
    near = lambda c: F.coalesce(F.lag(c).over(_order()), F.lit(0.0)) + F.coalesce(F.lead(c).over(_order()), F.lit(0.0)) + 2 * F.col(c)
    v = v.withColumn("_sw", near("_w")).withColumn("_sp", near("_pw"))
    s = F.when(F.col("reliable") & (F.col("_sw") > 0), F.col("_sp") / F.col("_sw")).otherwise(F.col("probability"))
    return v.withColumn("smoothed", s).drop("_w", "_pw", "_sw", "_sp")


def passages(v: DataFrame, threshold: float = PASSAGE_THRESHOLD) -> DataFrame:
    """Maximal runs of reliable sentences at or above the threshold; an unreliable one ends a run (gaps and islands)."""
    n = v.withColumn("_n", F.row_number().over(_order())).where(F.col("reliable") & (F.col("smoothed") >= threshold))
    n = n.withColumn("_island", F.col("_n") - F.row_number().over(_order()))
    words = F.sum("n_words")
    return n.groupBy("doc_id", "_island").agg(
        F.min("sentence_index").alias("first_sentence"), F.count("*").alias("sentences"), F.min_by("char_start", "_n").alias("char_start"), F.max_by("char_end", "_n").alias("char_end"),
        words.cast("bigint").alias("n_words"), F.try_divide(F.sum(F.col("probability") * F.col("n_words")), words).alias("mean_probability"), F.max("probability").alias("peak_probability"),
    ).drop("_island")


def statistics(v: DataFrame, threshold: float = FLAG_THRESHOLD) -> DataFrame:
    """A3: what the document model reads, from reliable measured sentences."""
    p, w = F.col("probability"), F.coalesce(F.col("n_words"), F.lit(0)).cast("double")
    heavy = F.greatest(w, F.lit(1.0))
    return v.where("reliable AND probability IS NOT NULL").groupBy("doc_id").agg(
        (F.sum(p * heavy) / F.sum(heavy)).alias("mean_p"), F.max(p).alias("max_p"), F.percentile(p, F.lit(0.9)).alias("q90_p"),
        (F.sum(F.when(p >= threshold, w).otherwise(0.0)) / F.greatest(F.sum(w), F.lit(1.0))).alias("share"), F.log1p(F.count("*").cast("double")).alias("log_sentences"),
    )


def verdicts(v: DataFrame, threshold: float = FLAG_THRESHOLD) -> DataFrame:
    """A4: machine share of the reliable words and the counts; a document with nothing measurable has share 0 and all words."""
    ok = F.col("reliable") & F.col("probability").isNotNull()
    w = F.coalesce(F.col("n_words"), F.lit(0))
    n = F.sum(F.when(ok, 1).otherwise(0))
    total = F.sum(F.when(ok, w).otherwise(0))
    share = F.coalesce(F.try_divide(F.sum(F.when(ok & (F.col("probability") >= threshold), w).otherwise(0)).cast("double"), total), F.lit(0.0))
    return v.groupBy("doc_id").agg(share.alias("machine_share"), F.count("*").alias("n_sentences"), F.when(n > 0, total).otherwise(F.sum(w)).cast("bigint").alias("n_words"), n.cast("bigint").alias("n_reliable_sentences"))


def bootstrap_share(v: DataFrame, threshold: float = FLAG_THRESHOLD, n_boot: int = 400, seed: int = 0) -> DataFrame:
    """A5: (doc_id, low, high), the 5th and 95th percentile of the share over resamples of a document's reliable sentences."""

    def run(part: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        p, w = part["probability"], part["n_words"].astype(float)
        low, high = 0.0, 1.0
        if len(p) >= 3:
            rng = np.random.default_rng(seed)
            idx = np.stack([rng.integers(0, len(p), size=len(p)) for _ in range(n_boot)])
            total = w[idx].sum(axis=1)
            shares = np.divide(np.where(p[idx] >= threshold, w[idx], 0.0).sum(axis=1), total, out=np.zeros(n_boot), where=total > 0)
            low, high = np.percentile(shares, 5), np.percentile(shares, 95)
        return {"doc_id": part["doc_id"][:1], "low": np.array([low]), "high": np.array([high])}

    rows = v.where("reliable AND probability IS NOT NULL AND n_words IS NOT NULL").select("doc_id", "sentence_index", "probability", "n_words")
    return map_runs(rows, "doc_id", ["sentence_index"], run, "doc_id string, low double, high double")


def gate_features(f: DataFrame, names: tuple[str, ...] = ("novel_trigram_rate", "first_person_rate", "specificity_rate"), key: str = "doc_id") -> DataFrame:
    """Word-weighted means per document, without NULLs and without zeros, and the mean sentence length."""
    w = F.when(F.col("n_words") > 0, F.col("n_words").cast("double")).otherwise(0.0)

    def mean(name: str) -> Column:
        x = F.nullif(F.col(name), F.lit(0.0))
        return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w))).alias(name)

    return f.groupBy(key).agg(*map(mean, names), (F.sum(w) / F.count("*")).alias("mean_sentence_words"))


def reliability(v: DataFrame, clipped_at: Column | None = None) -> Column:
    """Why a sentence cannot be measured: beyond the observer's window, too long, too short; NULL if it can."""
    beyond = clipped_at.isNotNull() & (F.col("char_start") >= clipped_at) if clipped_at is not None else F.lit(False)
    return F.when(beyond, "beyond_observer_window").when(F.col("n_words") > MAX_WORDS, "too_long").when(F.col("n_words") < MIN_TOKENS, "too_short")


def band(p: Column, measurable: Column, in_scope: Column, bands: dict = BANDS) -> Column:
    """The verdict's name; out of scope comes first, then nothing measurable, then the two cuts."""
    return F.when(~in_scope, "out_of_scope").when(~measurable, "unmeasurable").when(p >= bands["t_machine"], "likely_machine").when(p <= bands["t_human"], "no_evidence").otherwise("insufficient")


def clipped(x: Column, p: dict[str, float], cap: float = 5.0) -> Column:
    """The standardised value within +-cap; NULL gives 0 (least and greatest alone would skip a NULL and give the cap)."""
    return F.when(x.isNull(), 0.0).otherwise(F.least(F.greatest((x - p["mean"]) / p["scale"], F.lit(-cap)), F.lit(cap)))


def contributions(features: dict[str, dict[str, float]], cap: float = 5.0) -> dict[str, Column]:
    """M4: one column per feature: coefficient times the standardised value within +-cap; NULL contributes 0."""
    return {n: F.lit(p["coef"]) * clipped(F.col(n), p, cap) for n, p in features.items()}


def sigmoid(x: Column) -> Column:
    return F.when(x.isNotNull(), 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0)))))


def standardiser(df: DataFrame, names: list[str]) -> dict[str, dict[str, float]]:
    """M1: mean and population deviation of each feature in one aggregation; a flat or empty feature has scale 1, an empty one mean 0."""
    r = df.agg(*(F.avg(n).alias(f"m_{n}") for n in names), *(F.stddev_pop(n).alias(f"s_{n}") for n in names)).first()
    return {n: {"mean": r[f"m_{n}"] or 0.0, "scale": r[f"s_{n}"] if r[f"s_{n}"] is not None and r[f"s_{n}"] >= 1e-9 else 1.0} for n in names}


def fit_detector(df: DataFrame, names: list[str], label: str = "label", c: float = 0.1, balanced: bool = True) -> tuple[dict[str, dict[str, float]], float]:
    """M2: logistic regression on standardised, clipped features. The penalty 1 / (C n) is on the mean loss."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    params = standardiser(df, names)
    z = {n: clipped(F.col(n), p) for n, p in params.items()}
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, n / (2 * counts.get(1, n))).otherwise(n / (2 * counts.get(0, n))) if balanced else F.lit(1.0)
    rows = VectorAssembler(inputCols=names, outputCol="_x").transform(df.select(F.col(label).cast("double").alias("_y"), weight.alias("_w"), *(x.alias(k) for k, x in z.items())))
    m = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1 / (c * n), standardization=False, tol=1e-10, maxIter=2000).fit(rows)
    return {k: p | {"coef": float(w)} for (k, p), w in zip(params.items(), m.coefficients, strict=True)}, float(m.intercept)


def top_contributions(columns: dict[str, Column], k: int = 6) -> Column:
    """K1: the k largest contributions by size, ties in feature order, as an array of (name, contribution)."""
    all_ = F.array(*(F.struct((-F.abs(c)).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("name"), c.alias("contribution")) for i, (n, c) in enumerate(columns.items())))
    return F.transform(F.slice(F.array_sort(all_), 1, k), lambda x: F.struct(x["name"].alias("name"), x["contribution"].alias("contribution")))


def out_of_fold(df: DataFrame, names: list[str], group: str, folds: int = 5, label: str = "label") -> DataFrame:
    """M3 and M8: ``df`` with ``fold`` and the probability of a detector that saw no row of the row's group.

    Groups go whole to folds of about equal size; the loop is over folds, each fit runs distributed. Rows of the null
    group form one group.
    """
    from inkfathom.operators.corpus import fold_of_groups
    from inkfathom.session import cut_lineage

    key = F.coalesce(F.col(group).cast("string"), F.lit(""))
    d = df.withColumn("_g", key)
    d = d.join(fold_of_groups(d.groupBy("_g").agg(F.count("*").alias("_n")), "_n", folds).select("_g", "fold"), "_g").drop("_g")
    d = cut_lineage(d)
    out = None
    for k in range(folds):
        fitted, intercept = fit_detector(d.where(F.col("fold") != k), names, label)
        part = d.where(F.col("fold") == k).withColumn("probability", sigmoid(F.lit(intercept) + sum(contributions(fitted).values(), F.lit(0.0))))
        out = part if out is None else out.unionByName(part)
    return out
