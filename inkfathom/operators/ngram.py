"""N-gram reference: fit (A1), scoring (A2, J3-J5, W9) and the stand-in observer (O7) built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfathom.functions import text as X
from inkfathom.session import checked_broadcast

MIN_COUNT = 2
# Interpolation weights of the three orders and the floor of a probability.
WEIGHTS, FLOOR = (0.5, 0.3, 0.2), 1e-12
START, UNKNOWN = "<s>", "<unk>"


def word_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, pos, w): one row per word."""
    return df.select(*keys, F.posexplode(X.words(F.col(text))).alias("pos", "w"))


def _context(rows: DataFrame, keys: list[str]) -> DataFrame:
    o = W.partitionBy(*keys).orderBy("pos")
    return rows.withColumn("b", F.lag("w", 1, START).over(o)).withColumn("a", F.lag("w", 2, START).over(o))


def known_words(rows: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    return rows.groupBy("w").agg(F.count("*").alias("c")).where(F.col("c") >= min_count)


def fit(df: DataFrame, key: str, text: str = "text", min_count: int = MIN_COUNT) -> dict[str, DataFrame]:
    """Tables uni(w, c), bi(b, w, c), tri(a, b, w, c) and meta(total_tokens, vocab_size, n_documents), padded per document."""
    rows = word_rows(df, [key], text)
    vocab = known_words(rows, min_count)
    mapped = rows.join(checked_broadcast(vocab.select(F.col("w").alias("v"))), F.col("w") == F.col("v"), "left").select(key, "pos", F.coalesce("v", F.lit(UNKNOWN)).alias("w"))
    ctx = _context(mapped, [key])
    uni = mapped.groupBy("w").agg(F.count("*").alias("c"))
    bi = ctx.groupBy("b", "w").agg(F.count("*").alias("c"))
    tri = ctx.groupBy("a", "b", "w").agg(F.count("*").alias("c"))
    meta = mapped.agg(F.count("*").alias("total_tokens")).crossJoin(vocab.agg((F.count("*") + 1).alias("vocab_size"))).crossJoin(df.agg(F.count("*").alias("n_documents")))
    return {"uni": uni, "bi": bi, "tri": tri, "meta": meta}


def token_logprobs(sentences: DataFrame, keys: list[str], model: dict[str, DataFrame], text: str = "text") -> DataFrame:
    """(keys, pos, w, logprob, seen): natural log of the interpolated probability of each word, padded per sentence.

    Three joins, broadcast where a table's estimated size allows and by hash otherwise: a word's own count comes with the
    vocabulary, and the denominators are counts of the word before (its own count, and that of its pair), so a window over
    the sentence gives them.
    """
    uni, bi, tri = model["uni"], model["bi"], model["tri"]
    rows = word_rows(sentences, keys, text)
    known = checked_broadcast(uni.where(F.col("w") != UNKNOWN).select(F.col("w").alias("v"), F.col("c").alias("ck")))
    one = model["meta"].crossJoin(uni.where(F.col("w") == UNKNOWN).agg(F.sum("c").alias("cu")))
    mapped = rows.join(known, F.col("w") == F.col("v"), "left").crossJoin(F.broadcast(one))  # one row
    zero = F.lit(0)
    mapped = mapped.select(*keys, "pos", F.coalesce("v", F.lit(UNKNOWN)).alias("w"), F.coalesce("ck", "cu", zero).alias("c1"), "total_tokens", "vocab_size", "n_documents")
    o = W.partitionBy(*keys).orderBy("pos")
    c = _context(mapped, keys).withColumn("d2", F.lag("c1").over(o))
    c = c.join(checked_broadcast(bi.select("b", "w", F.col("c").alias("c2"))), ["b", "w"], "left")
    c = c.join(checked_broadcast(tri.select("a", "b", "w", F.col("c").alias("c3"))), ["a", "b", "w"], "left")
    c = c.withColumn("d3", F.coalesce(F.lag("c2").over(o), zero))
    p1 = (F.col("c1") + 1) / (F.col("total_tokens") + F.col("vocab_size"))
    d2 = F.when(F.col("b") == START, F.col("n_documents")).otherwise(F.coalesce("d2", zero))
    p2 = F.when(d2 > 0, F.coalesce("c2", zero) / d2).otherwise(p1)
    p3 = F.when(F.col("d3") > 0, F.coalesce("c3", zero) / F.col("d3")).otherwise(p2)
    p = F.greatest(WEIGHTS[0] * p3 + WEIGHTS[1] * p2 + WEIGHTS[2] * p1, F.lit(FLOOR))
    return c.select(*keys, "pos", "w", F.log(p).alias("logprob"), (F.coalesce("c3", zero) > 0).alias("seen"), "a", "b")


def corpus_features(sentences: DataFrame, keys: list[str], model: dict[str, DataFrame], text: str = "text") -> DataFrame:
    """(keys, F34-F36) per sentence; NULL under four words. Trigrams of the novelty rate are not padded."""
    t = token_logprobs(sentences, keys, model, text)
    inside = F.col("pos") >= 2
    a = t.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(-F.col("logprob")).alias("m"), F.stddev_samp(-F.col("logprob")).alias("sd"), F.avg(F.when(inside, F.when(F.col("seen"), 0.0).otherwise(1.0))).alias("novel"))
    ok = F.col("n") >= 4
    return a.select(*keys, F.when(ok, F.col("m")).alias("corpus_surprisal_mean"), F.when(ok, F.col("sd")).alias("corpus_surprisal_sd"), F.when(ok, F.col("novel")).alias("novel_trigram_rate"))


def followers(model: dict[str, DataFrame]) -> DataFrame:
    """O1 and O4 for the stand-in: (b, n_next, mu, sigma2, entropy) of the distribution over the words seen after each word."""
    total = model["bi"].groupBy("b").agg(F.sum("c").alias("d"), F.count("*").alias("n_next"))
    x = model["bi"].join(checked_broadcast(total), "b").withColumn("p", F.col("c") / F.col("d")).withColumn("l", F.log("p"))
    a = x.groupBy("b").agg(F.first("n_next").alias("n_next"), F.sum(F.col("p") * F.col("l")).alias("mu"), F.sum(F.col("p") * F.col("l") * F.col("l")).alias("q"))
    return a.select("b", "n_next", "mu", F.greatest(F.col("q") - F.col("mu") * F.col("mu"), F.lit(0.0)).alias("sigma2"), (-F.col("mu")).alias("entropy"))


def cross_entropies(model: dict[str, DataFrame]) -> DataFrame:
    """O6 for the stand-in: (b, xent): cross-entropy of the distribution over the words seen after each word against the
    smoothed single-word model, the second observer."""
    total = model["bi"].groupBy("b").agg(F.sum("c").alias("d"))
    p1 = model["uni"].select("w", F.col("c").alias("c1")).crossJoin(F.broadcast(model["meta"])).select("w", ((F.col("c1") + 1) / (F.col("total_tokens") + F.col("vocab_size"))).alias("q"))  # meta is one row
    x = model["bi"].join(checked_broadcast(total), "b").join(checked_broadcast(p1), "w")
    return x.groupBy("b").agg((-F.sum(F.col("c") / F.col("d") * F.log("q"))).alias("xent"))


def two_model_ratio(sentences: DataFrame, keys: list[str], model: dict[str, DataFrame], text: str = "text") -> DataFrame:
    """(keys, xent, ratio) per sentence of at least five tokens: mean cross-entropy of the two observers over tokens whose
    context has one, and mean surprisal over it."""
    t = token_logprobs(sentences, keys, model, text).join(checked_broadcast(cross_entropies(model).withColumnRenamed("b", "xb")), F.col("b") == F.col("xb"), "left")
    a = t.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(-F.col("logprob")).alias("s"), F.avg("xent").alias("xent")).where("n >= 5")
    return a.select(*keys, "xent", F.try_divide("s", "xent").alias("ratio"))


def observe(sentences: DataFrame, keys: list[str], model: dict[str, DataFrame], text: str = "text") -> DataFrame:
    """Token rows (keys, tok_idx, token, logprob, rank, entropy, mu, sigma2) of the stand-in observer.

    The rank of a word is its place in the back-off order: the words seen after the one before it by count, then all others
    by their count in the reference. entropy, mu and sigma2 are those of the words seen after the one before; NULL after a
    word that nothing followed, as with an observer that does not send a distribution (O3).
    """
    ranks = model["uni"].select(F.col("w").alias("rw"), F.rank().over(W.orderBy(F.desc("c"))).alias("r1"))
    seen = model["bi"].select(F.col("b").alias("fb"), F.col("w").alias("fw"), F.rank().over(W.partitionBy("b").orderBy(F.desc("c"))).alias("r2"))
    t = token_logprobs(sentences, keys, model, text).join(checked_broadcast(ranks), F.col("w") == F.col("rw"), "left")
    t = t.join(checked_broadcast(followers(model).withColumnRenamed("b", "nb")), F.col("b") == F.col("nb"), "left")
    t = t.join(checked_broadcast(seen), (F.col("b") == F.col("fb")) & (F.col("w") == F.col("fw")), "left")
    rank = F.coalesce("r2", F.coalesce("n_next", F.lit(0)) + F.coalesce("r1", F.lit(1 << 20)))
    return t.select(*keys, F.col("pos").alias("tok_idx"), F.col("w").alias("token"), "logprob", rank.alias("rank"), "entropy", "mu", "sigma2")


#: Ids of words fit into 16 bits.
MOST_WORDS = 65_535


def packed_keys(model: dict[str, DataFrame]) -> DataFrame:
    """(key, c): bigrams as one 64-bit key, first word's id in the upper half; ids from 1 by order of the words, 0 for the
    start. Refuses a vocabulary whose ids do not fit into 16 bits, beyond which keys would collide."""
    words = model["uni"].select("w").distinct()
    n = words.count()
    if n > MOST_WORDS:
        raise ValueError(f"{n} words do not fit into 16-bit ids")
    ids = words.select("w", F.row_number().over(W.orderBy("w")).alias("id"))  # at most MOST_WORDS rows
    a, b = ids.select(F.col("w").alias("b"), F.col("id").alias("ib")), ids.select("w", F.col("id").alias("iw"))
    x = model["bi"].join(checked_broadcast(a), "b", "left").join(checked_broadcast(b), "w")
    return x.select((F.shiftleft(F.coalesce("ib", F.lit(0)).cast("bigint"), 16) + F.col("iw")).alias("key"), F.col("c"))


def unpacked(packed: DataFrame, model: dict[str, DataFrame]) -> DataFrame:
    """(b, w, c) back from packed keys, for the round-trip check against the table they were made from."""
    ids = model["uni"].select("w").distinct().select("w", F.row_number().over(W.orderBy("w")).alias("id"))
    x = packed.select(F.shiftright("key", 16).cast("int").alias("ib"), F.col("key").bitwiseAND(0xFFFF).cast("int").alias("iw"), "c")
    x = x.join(checked_broadcast(ids.select(F.col("w").alias("b"), F.col("id").alias("ib"))), "ib", "left").join(checked_broadcast(ids.select("w", F.col("id").alias("iw"))), "iw")
    return x.select(F.coalesce("b", F.lit(START)).alias("b"), "w", "c")
