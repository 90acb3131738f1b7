"""Several observers on the same words: alignment (J2, J14, J20) and what they disagree about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, FAR = 30, 100.0


def word_scores(tokens: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word, tokens, logprob, log_rank) of each word (keys, word, start, end): the tokens (keys, char_start,
    char_end, logprob, rank) whose centre it holds, their mean logprob, and the log of their best rank."""
    centre = (F.col("t.char_start") + F.col("t.char_end")) / 2
    same = (centre >= F.col("w.start")) & (centre < F.col("w.end"))
    for k in keys:
        same = same & (F.col(f"t.{k}") == F.col(f"w.{k}"))
    x = words.alias("w").join(tokens.alias("t"), same).select(*(F.col(f"w.{k}") for k in keys), "w.word", "t.logprob", "t.rank")
    return x.groupBy(*keys, "word").agg(F.count("*").alias("tokens"), F.avg("logprob").alias("logprob"), F.log(F.greatest(F.min("rank"), F.lit(1))).alias("log_rank"))


def features(rows: DataFrame, keys: list[str]) -> DataFrame:
    """14 features of rows (keys, word, observer, logprob, log_rank), and the number of words.

    A word counts only if all observers of its document measured it (J14). Documents with under ``LEAST_WORDS`` such words
    or under two observers are left out. Spreads are population deviations over the observers of a word.
    """
    ok = rows.where("logprob IS NOT NULL AND log_rank IS NOT NULL AND NOT isnan(logprob) AND NOT isnan(log_rank)")
    n = rows.groupBy(*keys).agg(F.count_distinct("observer").alias("observers")).where("observers >= 2")
    lp, lr = F.col("logprob"), F.col("log_rank")
    first = lr <= 1e-9
    w = ok.groupBy(*keys, "word").agg(
        F.count("*").alias("seen"), F.avg(lp).alias("m"), F.stddev_pop(lp).alias("sd"), F.min(lp).alias("lo"), F.max(lp).alias("hi"), F.avg(lr).alias("mr"), F.stddev_pop(lr).alias("rsd"),
        F.bool_and(first).alias("all_first"), F.bool_or(first).alias("any_first"),
    ).join(n, keys).where("seen = observers")
    share = lambda c: F.avg(c.cast("double"))
    gap = F.col("hi") - F.col("lo")
    a = w.groupBy(*keys).agg(
        share(F.col("all_first")).alias("x_consensus_top1"), share(F.col("any_first")).alias("x_any_top1"), share(~F.col("any_first")).alias("x_no_top1"),
        F.avg("sd").alias("x_spread_lp"), F.stddev_pop("sd").alias("x_spread_lp_sd"), F.avg(gap).alias("x_range_lp"), F.avg("rsd").alias("x_spread_rank"), share(gap > F.log(F.lit(FAR))).alias("x_hard_disagree"),
        (-F.avg("m") / F.greatest(F.avg("sd"), F.lit(1e-6))).alias("x_binoc"), (F.avg("mr") / F.greatest(F.avg("rsd"), F.lit(1e-6))).alias("x_binoc_rank"),
        F.avg("lo").alias("x_min_lp"), F.avg("hi").alias("x_max_lp"), F.avg(F.col("hi") - F.col("m")).alias("x_best_gap"), F.count("*").cast("double").alias("x_n_words"),
    ).where(f"x_n_words >= {LEAST_WORDS}")
    kept = ok.join(w.select(*keys, "word"), [*keys, "word"], "left_semi")
    x, y = kept.select(*keys, "word", F.col("observer").alias("o1"), F.col("logprob").alias("l1")), kept.select(*keys, "word", F.col("observer").alias("o2"), F.col("logprob").alias("l2"))
    pairs = x.join(y, [*keys, "word"]).where("o1 < o2").groupBy(*keys, "o1", "o2")  # observers are few
    sds = F.stddev_pop("l1") * F.stddev_pop("l2")
    pairs = pairs.agg(F.when((F.stddev_pop("l1") > 1e-9) & (F.stddev_pop("l2") > 1e-9), F.covar_pop("l1", "l2") / sds).alias("r"))
    return a.join(pairs.groupBy(*keys).agg(F.avg("r").alias("x_corr_lp")), keys, "left")


def observers(verdicts: DataFrame) -> DataFrame:
    """Three observers made from verdict rows, a sentence standing for a word: each has its own view of the same score, and the
    third misses some."""
    p = F.least(F.greatest(F.coalesce("probability", F.lit(0.5)), F.lit(1e-6)), F.lit(1 - 1e-6))
    n = F.coalesce("n_words", F.lit(1))
    views = F.array(
        F.struct(F.lit("a").alias("observer"), F.log(p).alias("logprob"), F.log(1 + n % 7).alias("log_rank")),
        F.struct(F.lit("b").alias("observer"), F.log(1 - p).alias("logprob"), F.log(1 + n % 3).alias("log_rank")),
        F.struct(F.lit("c").alias("observer"), F.when(n % 5 > 0, F.log(p) / 2).alias("logprob"), F.log((1 + n % 2).cast("double")).alias("log_rank")),
    )
    return verdicts.select("source_id", F.concat("doc_id", F.lit(":"), F.col("sentence_index").cast("string")).alias("word"), F.explode(views).alias("v")).select("source_id", "word", "v.*")
