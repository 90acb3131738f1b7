"""Further core queries: projections, joins, audits and sampling. Same conventions as :mod:`core_queries`."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F


from inkfathom.operators import corpus, features, metrics, ngram
from inkfathom.operators.ranks import row_numbers
from inkfathom.plans.core_queries import DS, ES, LP, QUERIES, SC, SV, docs_scored, es, model, query, r6, sc, sentences, sv
from inkfathom.session import table



@query("flt_p3_p4_group_key", f"WITH {ES}\n--\nSELECT id, coalesce(nullif(meta->>'base_doc_id', ''), id) AS grp FROM es")
def _(s, d):
    return es(s, d).select("id", F.coalesce(F.nullif(F.get_json_object("meta", "$.base_doc_id"), F.lit("")), F.col("id")).alias("grp"))


@query("flt_p8_rank_bucket", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey <= 10 THEN 'top10' WHEN l_partkey <= 100 THEN 'top100' WHEN l_partkey <= 1000 THEN 'top1000' ELSE 'tail' END AS bucket FROM lineitem")
def _(s, d):
    k = F.col("l_partkey")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(k <= 10, "top10").when(k <= 100, "top100").when(k <= 1000, "top1000").otherwise("tail").alias("bucket"))


@query("flt_p9_esl_tag", f"WITH {ES}\n--\nSELECT id, coalesce(lower(trim(role)) = 'esl-eval' OR (meta->>'ell')::BOOLEAN, false) AS esl FROM es")
def _(s, d):
    return es(s, d).select("id", F.coalesce((F.lower(F.trim("role")) == "esl-eval") | F.get_json_object("meta", "$.ell").cast("boolean"), F.lit(False)).alias("esl"))


@query("flt_p10_p11_user_message", f"WITH {ES}\n--\nSELECT id, concat_ws(chr(10), CASE WHEN regexp_matches(topic, '(?i)^(write|describe|explain|discuss|tell)') THEN topic ELSE 'Write about ' || topic END, 'Style: ' || (meta->>'style')) AS message FROM (SELECT *, meta->>'topic' AS topic FROM es)")
def _(s, d):
    t = F.get_json_object("meta", "$.topic")
    ask = F.when(t.rlike("(?i)^(write|describe|explain|discuss|tell)"), t).otherwise(F.concat(F.lit("Write about "), t))
    return es(s, d).select("id", F.concat_ws("\n", ask, F.concat(F.lit("Style: "), F.get_json_object("meta", "$.style"))).alias("message"))


@query("flt_p19_p20_long_documents", f"WITH {SC}, n AS (SELECT doc_id, count(*) AS n, bool_or(label = 1) AS machine FROM sc GROUP BY doc_id)\n--\nSELECT doc_id, n, coalesce(machine, false) AS machine FROM n WHERE n >= 5")
def _(s, d):
    return sc(s, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("label") == 1), F.lit(False)).alias("machine")).where("n >= 5")


@query("n4_n5_formatting", "SELECT o_orderkey, printf('%s:%04d', o_orderpriority, (o_orderkey % 10000)::INT) AS key, CASE WHEN length(o_orderpriority) > 8 THEN left(o_orderpriority, 7) || '…' ELSE o_orderpriority END AS short FROM orders")
def _(s, d):
    p = F.col("o_orderpriority")
    return table(s, d, "orders").select("o_orderkey", F.format_string("%s:%04d", p, (F.col("o_orderkey") % 10000).cast("int")).alias("key"), F.when(F.length(p) > 8, F.concat(F.substring(p, 1, 7), F.lit("…"))).otherwise(p).alias("short"))


@query("n8_s7_date_cut", f"WITH {ES}\n--\nSELECT strftime(collected_at, '%Y-%m') AS month, count(*) AS n FROM es WHERE left(collected_at::VARCHAR, 10) <= '2024-11-30' GROUP BY 1")
def _(s, d):
    return es(s, d).where(F.date_format("collected_at", "yyyy-MM-dd") <= "2024-11-30").groupBy(F.date_format("collected_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("j9_positional_pairs", "WITH a AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT DISTINCT id FROM essays WHERE authorship = 'human')), b AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT DISTINCT id FROM essays WHERE authorship = 'machine'))\n--\nSELECT a.id AS human, b.id AS machine FROM a JOIN b USING (n)")
def _(s, d):
    e = table(s, d, "essays").select("id", "authorship").distinct()
    numbered = lambda a, name: row_numbers(e.where(F.col("authorship") == a).select(F.col("id").alias(name)), [F.col(name)], [])
    return numbered("human", "human").join(numbered("machine", "machine"), "n").select("human", "machine")


@query("j18_a24_within_source_contrast", f"WITH {DS}, g AS (SELECT source, sum((role = 'train')::INT) AS n, avg(mean_p) FILTER (role = 'train') AS a, avg(mean_p) FILTER (role <> 'train') AS b FROM ds GROUP BY source)\n--\nSELECT count(*) AS sources, sum(n * (a - b)) / sum(n) AS difference FROM g WHERE a IS NOT NULL AND b IS NOT NULL", "difference")
def _(s, d):
    train = F.col("role") == "train"
    g = docs_scored(s, d).groupBy("source").agg(F.sum(F.coalesce(train, F.lit(False)).cast("bigint")).alias("n"), F.avg(F.when(train, F.col("mean_p"))).alias("a"), F.avg(F.when(~train, F.col("mean_p"))).alias("b"))
    return g.where("a IS NOT NULL AND b IS NOT NULL").agg(F.count("*").alias("sources"), F.try_divide(F.sum(F.col("n") * (F.col("a") - F.col("b"))), F.sum("n")).alias("difference"))


@query("j19_k5_feature_ranking", f"WITH {DS}, u AS (SELECT label, unnest(['mean_p', 'max_p', 'q90_p', 'share']) AS feature, unnest([mean_p, max_p, q90_p, share]) AS s FROM ds WHERE label IS NOT NULL), c AS (SELECT feature, s, sum(label) AS pos, sum(1 - label) AS neg FROM u GROUP BY ALL), b AS (SELECT *, sum(neg) OVER (PARTITION BY feature ORDER BY s) - neg AS below FROM c), a AS (SELECT feature, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS auroc FROM b GROUP BY feature)\n--\nSELECT feature, auroc, abs(auroc - 0.5) AS strength FROM a", "auroc strength")
def _(s, d):
    names = ["mean_p", "max_p", "q90_p", "share"]
    u = docs_scored(s, d).where("label IS NOT NULL").unpivot(["label"], names, "feature", "s")
    return metrics.auroc(u, "s", "label", ["feature"]).select("feature", "auroc", F.abs(F.col("auroc") - 0.5).alias("strength"))


@query("k3_hash_shuffle", "SELECT id FROM (SELECT DISTINCT id FROM essays) ORDER BY sha256('7:' || id), id LIMIT 40")
def _(s, d):
    return table(s, d, "essays").select("id").distinct().orderBy(F.sha2(F.concat(F.lit("7:"), F.col("id")), 256), "id").limit(40)


@query("w16_first_sentences", f"WITH {SV}, r AS (SELECT doc_id, sentence_index, probability, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_index) AS n FROM sv)\n--\nSELECT doc_id, avg(probability) AS mean_of_first FROM r WHERE n <= 5 GROUP BY doc_id", "mean_of_first")
def _(s, d):
    return corpus.cap_per_key(sv(s, d).select("doc_id", "sentence_index", "probability"), ["doc_id"], [F.col("sentence_index")], 5).groupBy("doc_id").agg(F.avg("probability").alias("mean_of_first"))


@query("a41_length_deciles", f"WITH {ES}, x AS (SELECT authorship, n_words, row_number() OVER (PARTITION BY authorship ORDER BY n_words) - 1 AS i, count(*) OVER (PARTITION BY authorship) AS n FROM es WHERE n_words IS NOT NULL AND authorship IN ('human', 'machine')), k AS (SELECT unnest(range(1, 10)) AS k), dd AS (SELECT k, max(n_words) FILTER (authorship = 'human' AND i = floor(k * (n - 1) / 10)) AS human, max(n_words) FILTER (authorship = 'machine' AND i = floor(k * (n - 1) / 10)) AS machine FROM x, k GROUP BY k)\n--\nSELECT k, human, machine, abs(human - machine) AS gap FROM dd")
def _(s, d):
    x = es(s, d).where("authorship IN ('human', 'machine')").select("authorship", "n_words")
    m = corpus.rank_elements(x, "n_words", ["authorship"], {str(k): F.floor(k * (F.col("n") - 1) / 10) for k in range(1, 10)})
    of = lambda a: F.max(F.when(F.col("authorship") == a, F.col("element")))
    return m.groupBy(F.col("place").cast("bigint").alias("k")).agg(of("human").alias("human"), of("machine").alias("machine")).withColumn("gap", F.abs(F.col("human") - F.col("machine")))


@query("a42_ratio_of_means", "SELECT model, CASE WHEN count(*) >= 5 AND avg(n_tokens) > 1e-6 THEN avg(neurons) / avg(n_tokens) END AS ratio FROM (SELECT DISTINCT * FROM observations) WHERE neurons IS NOT NULL GROUP BY model", "ratio")
def _(s, d):
    o = table(s, d, "observations").distinct().where("neurons IS NOT NULL")
    return o.groupBy("model").agg(F.when((F.count("*") >= 5) & (F.avg("n_tokens") > 1e-6), F.avg("neurons") / F.avg("n_tokens")).alias("ratio"))


@query("o2_span_validation", f"WITH {SV}, {ES}, x AS (SELECT sv.*, es.text AS body, lag(char_end) OVER (PARTITION BY doc_id ORDER BY sentence_index) AS before FROM sv JOIN es ON sv.doc_id = es.id)\n--\nSELECT doc_id, sum((before > char_start)::INT)::BIGINT AS overlapping, sum((substring(body, char_start + 1, char_end - char_start) <> text)::INT)::BIGINT AS misaligned FROM x GROUP BY doc_id")
def _(s, d):
    x = sv(s, d).join(es(s, d).select(F.col("id").alias("doc_id"), F.col("text").alias("body")), "doc_id")
    x = x.withColumn("before", F.lag("char_end").over(W.partitionBy("doc_id").orderBy("sentence_index")))
    wrong = F.expr("substring(body, char_start + 1, char_end - char_start)") != F.col("text")
    return x.groupBy("doc_id").agg(F.sum((F.col("before") > F.col("char_start")).cast("bigint")).alias("overlapping"), F.sum(wrong.cast("bigint")).alias("misaligned"))


@query("o4_head_statistics", "WITH c AS (SELECT event_id, unnest(range(1, 6)) AS k, ln(1.0 / (unnest(range(1, 6)) + event_id % 7 + 1)) AS lp FROM events), m AS (SELECT event_id, sum(exp(lp)) AS m, sum(exp(lp) * lp) / sum(exp(lp)) AS mu, sum(exp(lp) * lp * lp) / sum(exp(lp)) AS q FROM c GROUP BY event_id)\n--\nSELECT event_id, m AS top_mass, mu, q - mu * mu AS sigma2, ln(m) - mu AS entropy FROM m", "top_mass mu sigma2 entropy")
def _(s, d):
    c = table(s, d, "events").select("event_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).withColumn("lp", F.log(1.0 / (F.col("k") + F.col("event_id") % 7 + 1)))
    return features.head_statistics(c, ["event_id"])




@query("f37_fluency_gap", f"WITH {LP}, f AS (SELECT k1, k2, avg(-logprob) AS m, avg(logprob) AS l, count(*) AS n FROM lp GROUP BY k1, k2)\n--\nSELECT k1, k2, CASE WHEN n >= 5 THEN m + l END AS fluency_typicality_gap FROM f", "fluency_typicality_gap")
def _(s, d):
    m = model(s, d)
    rows = sentences(s, d)
    keys = ["k1", "k2"]
    return ngram.corpus_features(rows, keys, m).join(features.observer_features(ngram.observe(rows, keys, m), keys), keys).select(*keys, (F.col("corpus_surprisal_mean") + F.col("mean_logprob")).alias("fluency_typicality_gap"))


QUERIES["a27_a28_resampled_auroc"] = lambda s, d: r6(metrics.auroc_resampled(sc(s, d), "probability", "label"))
