"""Structural features over a supplied parse table (doc_id, sentence_index, i, head, pos, is_stop, is_punct): X1-X8, and their place in the document: X9-X11.

A token whose head is itself is a root. Depths are found by joining a level at a time, at most ``MAX_DEPTH`` times; a
sentence with a token that no root reaches (a cycle) has no depth features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfathom.operators.context import context_features
from inkfathom.session import cut_lineage

MAX_DEPTH = 200
# Fixed value: the back-off factor of the tag model.
ALPHA = 0.4
# Tags of content words, and the tokens a sentence needs.
CONTENT, MIN_TOKENS = ("NOUN", "PROPN", "VERB", "ADJ", "ADV"), 4
KEYS = ["doc_id", "sentence_index"]


def token_depths(parse: DataFrame) -> DataFrame:
    """(keys, i, depth) by pointer doubling: a token's ancestor pointer and distance double in each round, so a tree of
    depth d takes log2(d) joins; a token in a cycle keeps a NULL depth."""
    p = cut_lineage(parse.select(*KEYS, "i", F.col("head").alias("up"), F.when(F.col("head") == F.col("i"), 0).otherwise(1).alias("far")))
    for _ in range(MAX_DEPTH.bit_length()):
        q = p.select(*KEYS, F.col("i").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        p = cut_lineage(p.join(q, [*KEYS, "up"], "left").select(*KEYS, "i", F.coalesce("up2", F.col("up")).alias("up"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far")))
        if p.where(F.col("far") <= MAX_DEPTH).join(p.select(*KEYS, F.col("i").alias("up"), F.col("far").alias("r")).where("r > 0"), [*KEYS, "up"], "left_semi").isEmpty():
            break
    roots = parse.where("head = i").select(*KEYS, F.col("i").alias("up"), F.lit(True).alias("root"))
    return p.join(roots, [*KEYS, "up"], "left").select(*KEYS, "i", F.when(F.col("root") & (F.col("far") <= MAX_DEPTH), F.col("far")).alias("depth"))


def structure(parse: DataFrame) -> DataFrame:
    """X1-X7 per sentence: depth maximum, mean and deviation over tokens that are not punctuation, children per inner token,
    share of stop words, content words per function word and entropy of tag trigrams."""
    d = token_depths(parse)
    t = parse.join(d, [*KEYS, "i"])
    real = t.where("NOT is_punct")
    content = F.col("pos").isin(*CONTENT)
    a = real.groupBy(*KEYS).agg(
        F.max("depth").alias("tree_depth_max"), F.avg(F.col("depth").cast("double")).alias("tree_depth_mean"), F.stddev_samp("depth").alias("tree_depth_sd"), F.bool_or(F.col("depth").isNull()).alias("bad"),
        F.avg(F.col("is_stop").cast("double")).alias("stopword_ratio"), F.try_divide(F.sum(content.cast("double")), F.nullif(F.sum((~content).cast("double")), F.lit(0.0))).alias("content_function_ratio"), F.count("*").alias("n_real"),
    )
    measured = ("tree_depth_max", "tree_depth_mean", "tree_depth_sd", "stopword_ratio", "content_function_ratio")
    a = a.where(~F.col("bad") & (F.col("n_real") >= MIN_TOKENS)).select(*KEYS, *measured)
    inner = parse.where("NOT is_punct").select(*KEYS, F.col("i").alias("head"))
    children = parse.where("head <> i").join(inner, [*KEYS, "head"], "left_semi").groupBy(*KEYS, "head").agg(F.count("*").alias("n")).groupBy(*KEYS).agg(F.avg("n").alias("branching_factor"))
    o = W.partitionBy(*KEYS).orderBy("i")
    tri = real.select(*KEYS, "i", F.lag("pos", 2).over(o).alias("a"), F.lag("pos", 1).over(o).alias("b"), F.col("pos").alias("c")).where("a IS NOT NULL")
    n = tri.groupBy(*KEYS, "a", "b", "c").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy(*KEYS))
    entropy = n.withColumn("p", p).groupBy(*KEYS).agg((-F.sum(F.col("p") * F.log2("p"))).alias("pos_trigram_entropy"))
    return a.join(children, KEYS, "left").join(entropy, KEYS, "left")


def tag_model(parse: DataFrame) -> dict[str, DataFrame]:
    """Tag counts with two starts and one end a sentence; the single counts include the padding."""
    s = parse.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("i", "pos"))).alias("l"))
    tags = F.concat(F.array(F.lit("<s>"), F.lit("<s>")), F.transform("l", lambda x: x["pos"]), F.array(F.lit("</s>")))
    t = s.select(*KEYS, F.posexplode(tags).alias("k", "c"))
    o = W.partitionBy(*KEYS).orderBy("k")
    t = t.withColumn("b", F.lag("c", 1).over(o)).withColumn("a", F.lag("c", 2).over(o))
    return {"uni": t.groupBy("c").agg(F.count("*").alias("n")), "bi": t.where("b IS NOT NULL").groupBy("b", "c").agg(F.count("*").alias("n")), "tri": t.where("a IS NOT NULL").groupBy("a", "b", "c").agg(F.count("*").alias("n")), "rows": t.where("k >= 2")}


def tag_surprisal(parse: DataFrame, model: dict[str, DataFrame]) -> DataFrame:
    """Mean bits per tag, the end included, by back-off from trigrams to pairs to single tags, each step down times ALPHA."""
    t = tag_model(parse)["rows"]
    uni, bi, tri = model["uni"], model["bi"], model["tri"]
    total = uni.agg(F.sum("n").alias("total"), F.sum((~F.col("c").isin("<s>", "</s>")).cast("int")).alias("kinds"))
    x = t.join(tri.withColumnRenamed("n", "n3"), ["a", "b", "c"], "left").join(bi.select(F.col("b").alias("a"), F.col("c").alias("b"), F.col("n").alias("d3")), ["a", "b"], "left")
    x = x.join(bi.withColumnRenamed("n", "n2"), ["b", "c"], "left").join(uni.select(F.col("c").alias("b"), F.col("n").alias("d2")), "b", "left").join(uni.withColumnRenamed("n", "n1"), "c", "left").crossJoin(F.broadcast(total))  # one row
    none = F.lit(ALPHA**3) / F.greatest("kinds", F.lit(1))
    p = F.when((F.col("n3") > 0) & (F.col("d3") > 0), F.col("n3") / F.col("d3")).when((F.col("n2") > 0) & (F.col("d2") > 0), ALPHA * F.col("n2") / F.col("d2")).when(F.col("n1") > 0, ALPHA * ALPHA * F.col("n1") / F.col("total")).otherwise(none)
    return x.groupBy(*KEYS).agg(F.avg(-F.log2(p)).alias("pos_trigram_surprisal"))


def context(features: DataFrame) -> DataFrame:
    """(keys, tree_depth_z_in_doc, local_depth_burstiness, pos_surprisal_z_in_doc) of rows with tree_depth_max and
    pos_trigram_surprisal (NULL where not measured); all NULL in documents of under five sentences."""
    x = features.select(*KEYS, F.col("tree_depth_max").cast("double").alias("n_words"), F.col("pos_trigram_surprisal").alias("mean_logprob"))
    got = context_features(x)
    return got.select(*KEYS, F.col("len_z_in_doc").alias("tree_depth_z_in_doc"), F.col("local_len_burstiness").alias("local_depth_burstiness"), F.col("logprob_z_in_doc").alias("pos_surprisal_z_in_doc"))
