"""Sentence features: surface (F15-F33), observer (F1-F14), corpus (F34-F37). NULL means not measured, never zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfathom.functions import lexicons as L
from inkfathom.functions import text as X
from inkfathom.operators.metrics import correlation

MIN_WORDS, MIN_TOKENS = 4, 5
SURFACE = "n_words mean_word_len long_word_rate root_ttr comma_rate punct_variety em_dash_rate subordination_rate function_word_rate machine_phrase_rate machine_word_rate hedge_rate booster_rate discourse_marker_rate first_person_rate contraction_rate specificity_rate tricolon antithesis".split()
OBSERVER = "mean_logprob logprob_sd logprob_iqr frac_rank_top1 frac_rank_top10 frac_rank_top100 frac_rank_tail mean_log_rank log_rank_sd mean_entropy entropy_sd lrr curvature surprisal_autocorr".split()
# The two patterns that the features are defined by.
TRICOLON = r"(?U)\b[\w'’]+(?:\s+[\w'’]+){0,3},\s+[\w'’]+(?:\s+[\w'’]+){0,3},\s+and\s+"
ANTITHESIS = r"(?is)\bnot (?:just|only|merely|simply)\b.{0,80}?\bbut\b|\bwas ?n[o'’]t\b.{0,60}?\bit was\b|\bmore than (?:just )?a\b"


def surface_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the F15-F33 columns (a ``n_words`` of ``df`` is replaced). One projection, no shuffle.

    All are NULL for texts with fewer than four words and for null texts; rates are per 100 words.
    """
    t = F.col(text)
    # The words are materialised once, behind a generator barrier that Catalyst does not inline.
    d = df.drop("n_words", "w").withColumn("w", F.explode_outer(F.array(F.struct(X.words(t).alias("w"), F.lower(t).alias("low")))))
    w = F.col("w.w")
    n = F.size(w)
    in_list = lambda words: F.size(F.filter(w, lambda x: x.isin(*words)))
    per = lambda c: c * (F.lit(100.0) / n)
    found = lambda pattern: F.regexp_count(t, F.lit(pattern))
    low = F.col("w.low")
    phrases = sum((F.when(F.contains(low, F.lit(p)), 1).otherwise(0) for p in L.MACHINE_PHRASES), F.lit(0))
    columns = {
        "n_words": n.cast("double"),
        "mean_word_len": F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / n,
        "long_word_rate": F.size(F.filter(w, lambda x: F.length(x) > 6)) / n,
        "root_ttr": F.size(F.array_distinct(w)) / F.sqrt(n),
        "comma_rate": per(found(",")),
        "punct_variety": F.size(F.array_distinct(F.regexp_extract_all(t, F.lit("[,;:—–\\-()\"'!?.]"), F.lit(0)))).cast("double"),
        "em_dash_rate": per(found("[—–]|(?<= )-{1,2}(?= )")),
        "subordination_rate": per(in_list(L.CLAUSE_MARKERS)),
        "function_word_rate": per(in_list(L.FUNCTION_WORDS)),
        "machine_phrase_rate": per(phrases),
        "machine_word_rate": per(in_list(L.MACHINE_WORDS)),
        "hedge_rate": per(in_list(L.HEDGES)),
        "booster_rate": per(in_list(L.BOOSTERS)),
        "discourse_marker_rate": per(in_list(L.DISCOURSE)),
        "first_person_rate": per(in_list(L.FIRST_PERSON)),
        "contraction_rate": per(found(r"(?iU)\b\w+['’](?:s|t|re|ve|ll|d|m)\b")),
        "specificity_rate": per(found("(?<=[a-z,;] )[A-Z][a-z]{2,}") + found(r"(?U)\d") + in_list(L.CONCRETE)),
        "tricolon": F.when(t.rlike(TRICOLON), 1.0).otherwise(0.0),
        "antithesis": F.when(t.rlike(ANTITHESIS), 1.0).otherwise(0.0),
    }
    return d.withColumns({k: F.when(n >= MIN_WORDS, v) for k, v in columns.items()}).drop("w")


def observer_features(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, F1-F14) of token rows (keys, tok_idx, logprob, rank, entropy, mu, sigma2); all NULL under five tokens.

    One aggregation by ``keys``; the lag for the autocorrelation shares its partitioning.
    """
    lp, lr = F.col("logprob").cast("double"), F.log(F.greatest(F.col("rank"), F.lit(1)))
    t = tokens.withColumn("prev", F.lag(lp).over(W.partitionBy(*keys).orderBy("tok_idx")))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    a = t.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(lp).alias("mean_logprob"), F.stddev_samp(lp).alias("logprob_sd"), (F.percentile(lp, F.lit(0.75)) - F.percentile(lp, F.lit(0.25))).alias("logprob_iqr"),
        share(F.col("rank") <= 1).alias("frac_rank_top1"), share(F.col("rank") <= 10).alias("frac_rank_top10"), share(F.col("rank") <= 100).alias("frac_rank_top100"), share(F.col("rank") > 1000).alias("frac_rank_tail"),
        F.avg(lr).alias("mean_log_rank"), F.stddev_samp(lr).alias("log_rank_sd"), F.avg("entropy").alias("mean_entropy"), F.stddev_samp("entropy").alias("entropy_sd"), F.avg("mu").alias("m"), F.avg("sigma2").alias("s2"),
        correlation(lp, "prev").alias("ac"),
    )
    a = a.withColumn("lrr", F.when(F.col("mean_log_rank") > 0, -F.col("mean_logprob") / F.col("mean_log_rank")))
    a = a.withColumn("curvature", (F.col("mean_logprob") - F.col("m")) / F.sqrt(F.greatest(F.col("s2"), F.lit(1e-9))))
    a = a.withColumn("surprisal_autocorr", F.when(F.col("n") > 3, F.col("ac")))
    return a.select(*keys, *(F.when(F.col("n") >= MIN_TOKENS, F.col(c)).alias(c) for c in OBSERVER))


def tokens_in_spans(tokens: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens joined to the span whose [start, end) holds the token's centre; spans without tokens stay.

    Equality on ``key`` carries the range condition, so the plan is a hash or merge join, never a nested loop.
    """
    centre = (F.col("t.char_start") + F.col("t.char_end")) / 2
    return spans.alias("s").join(tokens.alias("t"), (F.col(f"s.{key}") == F.col(f"t.{key}")) & (centre >= F.col("s.start")) & (centre < F.col("s.end")), "left").select("s.*", "t.tok_idx", "t.logprob", "t.rank", "t.entropy", "t.mu", "t.sigma2")




def head_statistics(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Mass of the listed candidates (rows of keys and lp), and mean, variance and entropy of the renormalised head."""
    p, lp = F.exp("lp"), F.col("lp")
    m = candidates.groupBy(*keys).agg(F.sum(p).alias("top_mass"), (F.sum(p * lp) / F.sum(p)).alias("mu"), (F.sum(p * lp * lp) / F.sum(p)).alias("q"))
    return m.select(*keys, "top_mass", "mu", (F.col("q") - F.col("mu") * F.col("mu")).alias("sigma2"), (F.log("top_mass") - F.col("mu")).alias("entropy"))
