"""In-document context of sentences: leave-one-out robust z (W1), scaling (W2), style gap (W3), burstiness (W4), position."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfathom.functions import lexicons as L
from inkfathom.operators.runs import map_runs

MIN_SENTENCES, CAP = 5, 6.0


def _median_without(s: np.ndarray, i: int) -> float:
    """Median of a sorted array without its i-th element."""
    n = len(s) - 1
    at = lambda k: s[k] if k < i else s[k + 1]
    return at(n // 2) if n % 2 else (at(n // 2 - 1) + at(n // 2)) / 2


def loo_z(x: np.ndarray) -> np.ndarray:
    """Robust z of each value against the others. One sort; a deviation's median per different centre."""
    out = np.full(len(x), np.nan)
    ok = np.flatnonzero(np.isfinite(x))
    if len(ok) < 4:
        return out
    order = ok[np.argsort(x[ok], kind="stable")]
    s = x[order]
    spread: dict[float, np.ndarray] = {}
    for i, at in enumerate(order):
        c = _median_without(s, i)
        if c not in spread:
            spread[c] = np.sort(np.abs(s - c))
        d = spread[c]
        j = int(np.searchsorted(d, abs(s[i] - c)))
        scale = 1.4826 * _median_without(d, j)
        delta = s[i] - c
        if scale < 1e-9:
            scale = float(np.std(np.delete(s, i), ddof=1))
        out[at] = (0.0 if abs(delta) < 1e-9 else np.copysign(CAP, delta)) if scale < 1e-9 else np.clip(delta / scale, -CAP, CAP)
    return out


def style_gap(columns: np.ndarray) -> np.ndarray:
    """Mean over the keys of |scaled value - median of the others' scaled values|; keys that cannot be scaled are skipped."""
    gaps = np.full(columns.shape, np.nan)
    for k in range(columns.shape[1]):
        x = columns[:, k]
        ok = np.flatnonzero(np.isfinite(x))
        if len(ok) < 3:
            continue
        m = np.median(x[ok])
        scale = 1.4826 * np.median(np.abs(x[ok] - m))
        if scale < 1e-9:
            scale = np.std(x[ok], ddof=1)
            scale = scale if scale >= 1e-9 else 1.0
        z = (x[ok] - m) / scale
        order = np.argsort(z, kind="stable")
        s = z[order]
        if len(s) > 1:
            for i, at in enumerate(order):
                gaps[ok[at], k] = abs(s[i] - _median_without(s, i))
    n = np.isfinite(gaps).sum(axis=1)
    return np.where(n > 0, np.nansum(gaps, axis=1) / np.maximum(n, 1), np.nan)


def burstiness(x: np.ndarray) -> np.ndarray:
    """W4 on an array: deviation over mean of the finite values among five neighbours."""
    out = np.full(len(x), np.nan)
    for i in range(len(x)):
        w = x[max(0, i - 2) : i + 3]
        w = w[np.isfinite(w)]
        if len(w) >= 3 and w.mean() >= 1e-9:
            out[i] = w.std(ddof=1) / w.mean()
    return out


def _keys(df: DataFrame) -> list[str]:
    return [k for k in L.STYLE_KEYS if k in df.columns]


def context_features(df: DataFrame, key: str = "doc_id", order: str = "sentence_index") -> DataFrame:
    """(key, order, F38-F43) of sentence rows that hold the style keys (missing ones count as not measured).

    A document is one group of a few hundred sentences at most; the leave-one-out medians have no window form in Spark
    (ordered windows reject medians), so they are computed on the sorted runs of an Arrow batch. All are NULL under five
    sentences.
    """
    keys = _keys(df)
    zs = [c for c in ("mean_logprob", "curvature", "n_words") if c in df.columns]
    names = {"mean_logprob": "logprob_z_in_doc", "curvature": "curvature_z_in_doc", "n_words": "len_z_in_doc"}
    need = list(dict.fromkeys([*zs, *keys]))
    kt, ot = df.schema[key].dataType.simpleString(), df.schema[order].dataType.simpleString()
    schema = f"`{key}` {kt}, `{order}` {ot}, " + ", ".join(f"{n} double" for n in (*names.values(), "style_gap_from_doc", "local_len_burstiness", "rel_position"))

    def run(part: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = len(part[key])
        none = np.full(n, np.nan)
        out = {key: part[key], order: part[order]} | dict.fromkeys([*names.values(), "style_gap_from_doc", "local_len_burstiness", "rel_position"], none)
        if n < MIN_SENTENCES:
            return out
        for c in zs:
            out[names[c]] = loo_z(part[c])
        if keys:
            out["style_gap_from_doc"] = style_gap(np.stack([part[k] for k in keys], 1))
        if "n_words" in zs:
            out["local_len_burstiness"] = burstiness(part["n_words"])
        out["rel_position"] = np.arange(n) / max(n - 1, 1)
        return out

    got = map_runs(df.select(key, order, *(F.col(c).cast("double") for c in need)), key, [order], run, schema)
    return got.select(key, order, *(F.nullif(F.col(c), F.lit(float("nan"))).alias(c) for c in got.columns if c not in (key, order)))


def local_burstiness(df: DataFrame, value: Column, key: str = "doc_id", order: str = "sentence_index") -> DataFrame:
    """W4 as a window: standard deviation over mean of up to five neighbours, NULL under three values."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-2, 2)
    return df.withColumn("local_len_burstiness", F.when((F.count(value).over(w) >= 3) & (F.avg(value).over(w) >= 1e-9), F.stddev_samp(value).over(w) / F.avg(value).over(w)))


def relative_position(df: DataFrame, key: str = "doc_id", order: str = "sentence_index") -> DataFrame:
    """Place in the document from 0 to 1."""
    w = W.partitionBy(key).orderBy(order)
    return df.withColumn("rel_position", (F.row_number().over(w) - 1) / F.greatest(F.count("*").over(W.partitionBy(key)) - 1, F.lit(1)))


def loo_mean_z(df: DataFrame, value: str, key: str = "doc_id") -> DataFrame:
    """Z against the mean and population deviation of the others, from sums; 0 where they do not vary, within +-6."""
    w = W.partitionBy(key)
    x = F.coalesce(F.col(value), F.avg(value).over(w))
    d = df.withColumn("_x", x - F.avg(x).over(w))  # centred first, against cancellation
    n = F.count("*").over(w) - 1
    m = (F.sum("_x").over(w) - F.col("_x")) / F.nullif(n, F.lit(0))
    v = (F.sum(F.col("_x") * F.col("_x")).over(w) - F.col("_x") * F.col("_x")) / F.nullif(n, F.lit(0)) - m * m
    sd = F.sqrt(F.greatest(v, F.lit(0.0)))
    return d.withColumn(f"{value}_loo_z", F.when(sd < 1e-9, 0.0).otherwise(F.least(F.greatest((F.col("_x") - m) / sd, F.lit(-CAP)), F.lit(CAP)))).drop("_x")
