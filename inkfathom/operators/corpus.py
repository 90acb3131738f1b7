"""Corpus laboratory: records, sets, splits, sampling and joins between tables (S, U, K, P, J)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfathom.functions import text as X
from inkfathom.operators.ranks import row_numbers, running_sums
from inkfathom.session import checked_broadcast


def one_per_id(essays: DataFrame) -> DataFrame:
    """U2 on ids: of several deliveries of an essay the last one ingested (ties by hash, then text)."""
    w = W.partitionBy("id").orderBy(F.desc("ingested_at"), F.asc_nulls_first("sha256"), "text")
    return essays.where("id IS NOT NULL").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order; null keys are kept apart from each other only by the order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def records(df: DataFrame, text: str = "text") -> DataFrame:
    """S3: canonical text, its words by white space and its SHA-256."""
    t = X.canonical(F.col(text))
    return df.withColumn(text, t).withColumn("n_words", X.count_words(F.col(text))).withColumn("sha256", F.sha2(F.col(text), 256))


def upper_median(c: Column) -> Column:
    """sorted(v)[n // 2]: an element, not a mean."""
    s = F.array_sort(F.collect_list(c))
    return F.element_at(s, (F.floor(F.count(c) / 2) + 1).cast("int"))


def nearest_rank(c: Column, p: float) -> Column:
    """sorted(v)[int(p * (n - 1))]."""
    s = F.array_sort(F.collect_list(c))
    return F.element_at(s, (F.floor(p * (F.count(c) - 1)) + 1).cast("int"))


def rank_elements(df: DataFrame, value: str, by: list[str], places: dict[str, Column]) -> DataFrame:
    """(by, place, element): the elements at named 0-based places (expressions over n) of the sorted non-null values of each
    group, from running counts of the different values: no group is sorted or collected in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("element")).agg(F.count("*").alias("_c"))
    d = running_sums(counts, by, "element", ["_c"]).withColumnRenamed("_c_all", "n")
    d = d.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("place"), p.cast("bigint").alias("at")) for k, p in places.items()))).alias("_p"))
    return d.where((F.col("_c_upto") > F.col("_p.at")) & (F.col("_c_upto") - F.col("_c") <= F.col("_p.at"))).select(*by, "_p.place", "element")


def rank_element(df: DataFrame, value: str, by: list[str], place: Column, name: str) -> DataFrame:
    """The element at one place of each group, see :func:`rank_elements`."""
    return rank_elements(df, value, by, {"": place}).select(*by, F.col("element").alias(name))


def even_half(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Half 0 or 1 by a row's place among the sorted keys of its set; a set may hold any share of the rows."""
    return row_numbers(df, [F.col(key)], by, "_n").withColumn("half", ((F.col("_n") - 1) % 2).cast("int")).drop("_n")


def cap_per_key(df: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows of each key, in a stated order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= cap).drop("_r")


def within_budget(df: DataFrame, by: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """Rows in order whose running cost before them is below the budget."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(cost).over(w), F.lit(0.0))).where(F.col("_before") < budget).drop("_before")


def cache_misses(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests that the cache does not hold, each once."""
    return requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def label(authorship: Column, middle: Column | None = None, spans: Column | None = None) -> Column:
    """0 for human, 1 for machine; a hybrid's sentence is 1 if its middle lies in a machine span."""
    inside = F.exists(spans, lambda s: (s["s"] <= middle) & (middle < s["e"])) if spans is not None else F.lit(True)
    return F.when(authorship == "human", 0).when(authorship == "machine", 1).when(authorship == "hybrid", inside.cast("int"))


def fold_of_groups(groups: DataFrame, size: str, folds: int = 5) -> DataFrame:
    """Whole groups to folds of about equal size: largest first in a snake over the folds, ties by key."""
    key = [c for c in groups.columns if c != size][0]
    n = F.row_number().over(W.orderBy(F.desc(size), key)) - 1
    lap, place = F.floor(n / folds), n % folds
    return groups.withColumn("fold", F.when(lap % 2 == 0, place).otherwise(folds - 1 - place).cast("int"))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def merged_scores(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, tolerance: float = 1e-9) -> DataFrame:
    """Full outer comparison of two score columns: missing on a side, different, or equal (two NULLs are equal)."""
    x, y = left.select(*keys, F.col(a).alias("_a"), F.lit(True).alias("_l")), right.select(*keys, F.col(b).alias("_b"), F.lit(True).alias("_r"))
    j = x.join(y, keys, "full")
    same = F.col("_a").eqNullSafe(F.col("_b")) | (F.abs(F.col("_a") - F.col("_b")) <= tolerance)
    return j.select(*keys, F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").when(F.coalesce(same, F.lit(False)), "equal").otherwise("different").alias("outcome"))


def attach(df: DataFrame, dimension: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A dimension joined by key, broadcast where its estimated size allows."""
    return df.join(checked_broadcast(dimension), on, how)


def usable(df: DataFrame, text: str, target: str, preamble: str, markdown: str, trailer: str) -> DataFrame:
    """P5: ``df`` with the first reason why a text is no usable essay, NULL if there is none. ``target`` is the number of words
    asked for."""
    t = F.col(text)
    count = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    words, first = count(t), F.regexp_replace(F.split(t, "\n")[0], r"^[ \t\r]+|[ \t\r]+$", "")
    last = lambda c: F.substring(c, -1, 1)
    title = (count(first) <= 9) & ~last(first).isin(".", "!", "?", '"', "'", ",") & (F.size(F.split(t, "\n")) > 1)
    reason = (
        F.when(t == "", "empty").when(t.rlike(preamble), "preamble").when(t.rlike(markdown), "markdown").when(t.rlike(trailer), "trailing note").when(words < 400, "too short")
        .when(F.abs((words - F.col(target)) / F.col(target)) > 0.25, "drift").when(~last(F.regexp_replace(t, r"\s+$", "")).isin(".", "!", "?", '"', "'"), "ends mid-sentence").when(title, "title")
    )
    return df.withColumn("reason", reason)


def cleaned_prompt(t: Column) -> Column:
    """P10: without a label in front; a verb is put first if none of the five is there."""
    bare = F.trim(F.regexp_replace(t, r"(?i)^(prompt|topic|question|essay)\s*:\s*", ""))
    return F.when(bare.rlike(r"(?i)^(write|describe|explain|discuss|tell)\b"), bare).otherwise(F.concat(F.lit("Write about "), bare))


def masked(t: Column, kept: Iterable[str]) -> Column:
    """Each word that is none of ``kept`` becomes #; what stands between words stays as it is."""
    parts = F.split(F.regexp_replace(t, r"(\p{L}+)", "\u0001$1\u0001"), "\u0001")
    words = list(kept)
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\p{L}+$") & ~F.lower(x).isin(*words), "#").otherwise(x)), "")


def add_new_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with new columns; refuses to put them over columns that it has already."""
    known = sorted(set(columns) & set(df.columns))
    if known:
        raise ValueError(f"already there: {', '.join(known)}")
    return df.withColumns(columns)


def limitations(df: DataFrame, served: DataFrame, on: str) -> DataFrame:
    """(source_id, note, tag): the served build's note for a row's set, with its licence where there is one, or else a
    fallback."""
    x = df.join(checked_broadcast(served), on, "left")
    note = F.coalesce(F.concat("note", F.lit(" ("), "licence", F.lit(")")), F.col("note"), F.concat(F.lit("no figures for "), F.coalesce(F.col(on), F.lit("this set"))))
    return x.select("source_id", note.alias("note"), F.when(F.col("note").isNull(), "fallback").otherwise("served").alias("tag"))


def validated_merge(left: DataFrame, right: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(doc_id, outcome) of merging rows (doc_id, i, a, b, expected) and (doc_id, i, a, b, ratio): a document is refused if
    the index sets differ, else if any span does, else if any ratio is off by more than the tolerance (relative or absolute)."""
    x = left.alias("l").join(right.alias("r"), F.expr("l.doc_id = r.doc_id AND l.i = r.i"), "full")
    alone = F.col("l.doc_id").isNull() | F.col("r.doc_id").isNull()
    span = (F.col("l.a") != F.col("r.a")) | (F.col("l.b") != F.col("r.b"))
    off = F.abs(F.col("r.ratio") - F.col("l.expected")) > tolerance * F.greatest(F.lit(1.0), F.abs(F.col("l.expected")))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return x.groupBy(F.coalesce("l.doc_id", "r.doc_id").alias("doc_id")).agg(F.when(any_(alone), "index set").when(any_(span), "span").when(any_(off), "ratio").otherwise("merged").alias("outcome"))


def keep_old(new: DataFrame, old: DataFrame, key: str, note: str) -> DataFrame:
    """(key, note, kept): a note that somebody wrote survives the regeneration; empty ones do not."""
    x = new.join(old.select(key, F.nullif(F.col(note), F.lit("")).alias("_old")), key, "left")
    return x.select(key, F.coalesce("_old", note).alias(note), F.col("_old").isNotNull().alias("kept"))


def manifest(df: DataFrame, registry: DataFrame) -> DataFrame:
    """(source_id, kind, value): each different hash of a listed source, its upper median of words, and a row ``dead`` for
    a source that gave nothing. Hashes are rows, so no source is collected into one."""
    d = df.where("source_id IS NOT NULL").join(checked_broadcast(registry), "source_id", "left_semi")
    hashes = d.where("sha256 IS NOT NULL").select("source_id", F.lit("hash").alias("kind"), F.lower("sha256").alias("value")).distinct()
    middle = rank_element(d, "n_words", ["source_id"], F.floor(F.col("n") / 2), "middle").select("source_id", F.lit("middle").alias("kind"), F.col("middle").cast("string").alias("value"))
    dead = registry.join(df.select("source_id"), "source_id", "left_anti").select("source_id", F.lit("dead").alias("kind"), F.lit(None).cast("string").alias("value"))
    return hashes.unionByName(middle).unionByName(dead)


def bundles(verdicts: DataFrame, essays: DataFrame, closed: DataFrame) -> DataFrame:
    """(doc_id, spans, digest, missing_text) of essays whose source's licence allows it; the digest is over the spans in
    order. A document's spans are its sentences."""
    ok = essays.join(checked_broadcast(closed), "source_id", "left_anti").select(F.col("id").alias("doc_id"), F.col("text").isNull().alias("missing_text"))
    spans = verdicts.groupBy("doc_id").agg(F.count("*").alias("spans"), F.array_sort(F.collect_list(F.struct("sentence_index", "char_start", "char_end"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat(x["sentence_index"].cast("string"), F.lit(":"), x["char_start"].cast("string"), F.lit("-"), x["char_end"].cast("string"))), ";")
    return spans.join(ok, "doc_id").select("doc_id", "spans", F.md5(text).alias("digest"), "missing_text")


def quotes(sentences: DataFrame, essays: DataFrame, most: int = 320, least: int = 200, share: float = 0.35) -> DataFrame:
    """(doc_id, sentence_index, quote, text): text is withheld (NULL); a quote of at most ``most`` characters is given as long
    as a document's quotes together stay within a share of it."""
    x = sentences.select("doc_id", "sentence_index", F.substring("text", 1, most).alias("q")).join(essays, "doc_id")
    w = W.partitionBy("doc_id").orderBy("sentence_index")
    fits = F.sum(F.length("q")).over(w) <= F.greatest(F.lit(least), F.floor(share * F.length("whole")))
    return x.select("doc_id", "sentence_index", F.when(fits, F.col("q")).alias("quote"), F.lit(None).cast("string").alias("text"))
