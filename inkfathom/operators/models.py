"""Calibration, gate, controls and protocols on fitted detectors (M3, M5-M14, N12), and their artifacts.

Fits run distributed; what comes to the driver are coefficients, one row per fold or protocol step.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.operators import document, metrics
from inkfathom.operators.ranks import quantiles
from inkfathom.session import cut_lineage

KNOTS, FEWEST_GROUPS = 201, 5


# --- calibration ---------------------------------------------------------------------------------------------------
def _logistic(rows: DataFrame, names: list[str], label: str, penalty: float, weight: Column | None = None):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=names, outputCol="_x").transform(rows.select(F.col(label).cast("double").alias("_y"), (weight if weight is not None else F.lit(1.0)).alias("_w"), *names))
    m = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c", regParam=penalty, standardization=False, tol=1e-12, maxIter=3000).fit(x)
    return [float(v) for v in m.coefficients], float(m.intercept)


def knots_of(slope: float, intercept: float) -> list[float]:
    """The curve of a logistic function of a probability at 201 places from 0 to 1."""
    return [1 / (1 + math.exp(-(slope * i / (KNOTS - 1) + intercept))) for i in range(KNOTS)]


def platt_knots(df: DataFrame, probability: str, label: str, group: str) -> list[float] | None:
    """M3: Platt scaling of out-of-fold probabilities, with hardly any penalty (C = 1e6), as knots. None, which leaves
    probabilities as they are, with fewer than five groups or one class."""
    n, groups, classes = df.agg(F.count("*"), F.count_distinct(F.coalesce(F.col(group).cast("string"), F.lit(""))), F.count_distinct(label)).first()
    if groups < FEWEST_GROUPS or classes < 2:
        return None
    (slope,), intercept = _logistic(df, [probability], label, 1 / (1e6 * n))
    return knots_of(slope, intercept)


def interpolate(p: Column, knots: list[float] | None) -> Column:
    """Piecewise linear between the knots, clamped to [0, 1]; without knots the probability itself."""
    if knots is None:
        return p
    y = F.array(*map(F.lit, knots))
    at = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * (len(knots) - 1)
    k = F.floor(at).cast("int")
    low, high = F.element_at(y, k + 1), F.element_at(y, F.least(k + 2, F.lit(len(knots))))
    return F.when(p.isNotNull(), low + (high - low) * (at - k))


# --- gate ----------------------------------------------------------------------------------------------------------
def fit_gate(df: DataFrame, names: list[str], label: str, c: float = 1.0) -> tuple[dict[str, dict[str, float]], float]:
    """M6: logistic regression on standardised features within +-5, NULL as 0, penalty 1 / (C n) on the mean loss, no class
    weights: the minimum that full-batch gradient descent on the same loss approaches."""
    return document.fit_detector(df, names, label, c=c, balanced=False)


def gate_probability(fitted: dict[str, dict[str, float]] | None, intercept: float = 0.0) -> Column:
    """M6: probability of being in scope; a gate that is not fitted refuses nothing (1)."""
    if not fitted:
        return F.lit(1.0)
    return document.sigmoid(F.lit(float(intercept)) + sum(document.contributions(fitted).values(), F.lit(0.0)))


def fit_probe(df: DataFrame, names: list[str], label: str, penalty: float = 1e-3) -> tuple[dict[str, dict[str, float]], float]:
    """M7: logistic regression on standardised features with a fixed penalty."""
    n = df.count()
    return document.fit_detector(df, names, label, c=1 / (penalty * n), balanced=False) if n else ({}, 0.0)


def document_probability(fitted: dict[str, dict[str, float]] | None, intercept: float = 0.0) -> Column:
    """M5: the document model's probability; the largest sentence probability where no model is fitted."""
    return document.sigmoid(F.lit(intercept) + sum(document.contributions(fitted).values(), F.lit(0.0))) if fitted else F.col("max_p")


# --- protocols -----------------------------------------------------------------------------------------------------
def scored(df: DataFrame, model: tuple[dict, float], name: str = "score") -> DataFrame:
    fitted, intercept = model
    return df.withColumn(name, document.sigmoid(F.lit(intercept) + sum(document.contributions(fitted).values(), F.lit(0.0))))


def _both(df: DataFrame, label: str) -> bool:
    return df.select(label).distinct().count() > 1


def leave_one_out(df: DataFrame, names: list[str], label: str, generator: Column) -> DataFrame:
    """M9: (left_out, n, auroc): for each generator a detector fitted without it and tested on it and on the human documents
    that the fit did not see (half of them, by hash). The loop is over generators, of which there are few."""
    d = cut_lineage(df.withColumn("_g", generator).withColumn("_held", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0))
    out = None
    for (g,) in d.where("_g IS NOT NULL").select("_g").distinct().orderBy("_g").collect():
        train = d.where((F.col(label) == 1) & (F.col("_g") != g) | (F.col(label) == 0) & ~F.col("_held"))
        test = d.where((F.col("_g") == g) | (F.col(label) == 0) & F.col("_held"))
        if not (_both(train, label) and _both(test, label)):
            continue
        part = metrics.auroc(scored(test, document.fit_detector(train, names, label)), "score", label, []).select(F.lit(g).alias("left_out"), (F.col("positives") + F.col("negatives")).alias("n"), "auroc")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "left_out string, n bigint, auroc double")


def control_battery(df: DataFrame, names: list[str], label: str, length: str, seed: int = 7) -> DataFrame:
    """(control, auroc) of a detector fitted on one half and tested on the other, under six controls: all features, the
    length alone, all but the length's correlate, labels shuffled in training, features shuffled in the test, and the
    middle half of the lengths only."""
    d = cut_lineage(df.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(2))))
    train, test = d.where("_h = 0"), d.where("_h = 1")
    if not (_both(train, label) and _both(test, label)):
        return df.sparkSession.createDataFrame([], "control string, auroc double")
    full = document.fit_detector(train, names, label)
    share = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
    noise = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) < share).cast("int")
    related = max(names, key=lambda n: abs(train.agg(metrics.correlation(n, length)).first()[0] or 0.0))
    q = {r.share: r.value for r in quantiles(test, [], length, [0.25, 0.75]).collect()}
    moments = {n: p for n, p in document.standardiser(test, names).items()}
    mixed = test.withColumns({n: F.lit(p["mean"]) + F.lit(p["scale"]) * (F.pmod(F.xxhash64("doc_id", F.lit(n)), F.lit(1000)) / 500.0 - 1) for n, p in moments.items()})
    runs = {
        "all": (full, test), "length_only": (document.fit_detector(train, [length], label), test), f"without_{related}": (document.fit_detector(train, [n for n in names if n != related], label), test),
        "shuffled_labels": (document.fit_detector(train.withColumn(label, noise), names, label), test), "shuffled_features": (full, mixed), "middle_lengths": (full, test.where(F.col(length).between(q[0.25], q[0.75]))),
    }
    out = None
    for name, (model, rows) in runs.items():
        part = metrics.auroc(scored(rows, model), "score", label, []).select(F.lit(name).alias("control"), "auroc")
        out = part if out is None else out.unionByName(part)
    return out


def polish_head(df: DataFrame, names: list[str], label: str, key: str, order: str) -> DataFrame:
    """(auroc, threshold, false_boundary_rate, adjacent_rate) of a head on leave-one-out features of each sentence
    within its document; the place in the document is left out, as it gives the seam away."""
    from inkfathom.operators import context, probes

    d = df
    for n in names:
        d = context.loo_mean_z(d.withColumn(n, F.col(n).cast("double")), n, key)
    z = [f"{n}_loo_z" for n in names]
    d = cut_lineage(d.select(key, order, label, *z))
    out = scored(d, fit_probe(d, z, label))
    a = metrics.auroc(out, "score", label, []).select("auroc")
    return a.crossJoin(F.broadcast(probes.boundary_rates(out, key, order, "score", label, 0.95)))  # one row each


def arm(df: DataFrame, names: list[str], label: str, key: str) -> DataFrame:
    """(key, probability, contributions..., intercept, threshold, flagged): a regression without class weights, each
    row's exact terms, and the 95th percentile of the human probabilities as threshold."""
    fitted, intercept = document.fit_detector(df, names, label, balanced=False)
    terms = document.contributions(fitted)
    x = df.select(key, label, document.sigmoid(F.lit(intercept) + sum(terms.values(), F.lit(0.0))).alias("probability"), *(c.alias(f"{n}_term") for n, c in terms.items()), F.lit(intercept).alias("intercept"))
    t = quantiles(x.where(F.col(label) == 0), [], "probability", [0.95]).select(F.col("value").alias("threshold"))
    return x.drop(label).crossJoin(F.broadcast(t)).withColumn("flagged", F.col("probability") >= F.col("threshold"))  # t has one row


def length_ablation(df: DataFrame, names: list[str], length: str, label: str, group: str) -> DataFrame:
    """(features, auroc) of out-of-fold probabilities with and without the length."""
    out = None
    for name, used in (("with_length", [*names, length]), ("without_length", names)):
        part = metrics.auroc(document.out_of_fold(df, used, group, label=label), "probability", label, []).select(F.lit(name).alias("features"), "auroc")
        out = part if out is None else out.unionByName(part)
    return out


def train_all(df: DataFrame, names: list[str], label: str, group: str, path: str) -> DataFrame:
    """M8: (name, value) of what a training run decides, after saving its artifacts under ``path``: out-of-fold probabilities by
    group, their calibration, the detector on all rows, the flag threshold, the bands and the document cut."""
    from inkfathom.operators.document import fit_detector, out_of_fold

    spark = df.sparkSession
    x = out_of_fold(df, names, group, label=label)
    knots = platt_knots(x, "probability", label, group)
    x = cut_lineage(x.withColumn("p", interpolate(F.col("probability"), knots)))
    fitted, intercept = fit_detector(df, names, label)
    flag = metrics.choose_threshold(x, "p", label, []).first()
    bands = metrics.fit_bands(x, "p", label).first()
    cut = metrics.budget_cut(x.where(F.col(label) == 0), "p", 0.05).first()
    area = metrics.auroc(x, "p", label, []).first()
    out = {"flag_threshold": flag.threshold if flag else None, "t_human": bands.t_human, "t_machine": bands.t_machine, "document_cut": cut.cut if cut else None, "auroc": area.auroc if area else None}
    save_model(spark, path, fitted, intercept, knots=knots, thresholds=out)
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in out.items()], "name string, value double")


# --- artifacts -----------------------------------------------------------------------------------------------------
def save_model(spark: SparkSession, path: str, fitted: dict[str, dict[str, float]], intercept: float, **more: object) -> None:
    """A model as one JSON row; ``more`` (threshold, knots, metadata) is kept as it is."""
    body = json.dumps({"feature_names": list(fitted), **{k: [p[k] for p in fitted.values()] for k in ("mean", "scale", "coef")}, "intercept": intercept, **more})
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> tuple[dict[str, dict[str, float]], float, dict]:
    """What :func:`save_model` wrote: the fitted features, the intercept and everything else."""
    d = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one row
    fitted = {n: {"mean": m, "scale": s, "coef": c} for n, m, s, c in zip(d.pop("feature_names"), d.pop("mean"), d.pop("scale"), d.pop("coef"), strict=True)}
    return fitted, d.pop("intercept"), d


def save_ngrams(model: dict[str, DataFrame], path: str, separator: str = " ") -> None:
    """The n-gram tables with their words joined in one key, by order."""
    rows = model["tri"].select(F.lit(3).alias("n"), F.concat_ws(separator, "a", "b", "w").alias("key"), "c").unionByName(model["bi"].select(F.lit(2).alias("n"), F.concat_ws(separator, "b", "w").alias("key"), "c")).unionByName(model["uni"].select(F.lit(1).alias("n"), F.col("w").alias("key"), "c"))
    rows.write.mode("overwrite").partitionBy("n").parquet(f"{path}/grams")
    model["meta"].write.mode("overwrite").json(f"{path}/meta")


def load_ngrams(spark: SparkSession, path: str, separator: str = " ") -> dict[str, DataFrame]:
    """The tables that :func:`save_ngrams` wrote."""
    rows = spark.read.parquet(f"{path}/grams")
    part = F.split("key", separator, -1)
    of = lambda n, *names: rows.where(F.col("n") == n).select(*(part[i].alias(x) for i, x in enumerate(names)), "c")
    meta = spark.read.schema("total_tokens bigint, vocab_size bigint, n_documents bigint").json(f"{path}/meta")
    return {"tri": of(3, "a", "b", "w"), "bi": of(2, "b", "w"), "uni": of(1, "w"), "meta": meta}


def gradient_norm(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float) -> float:
    """Length of the gradient of the mean logistic loss with an L2 penalty on all but the intercept (w[0])."""
    p = 1 / (1 + np.exp(-(x @ w[1:] + w[0])))
    g = np.concatenate([[np.mean(p - y)], x.T @ (p - y) / len(y) + penalty * w[1:]])
    return float(np.linalg.norm(g))
