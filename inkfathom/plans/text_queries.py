"""Queries that start from text: segmentation, observer families, structure, alignment. Conventions of :mod:`core_queries`."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfathom.functions import lexicons as L
from inkfathom.operators import consensus, context, document, features, ngram, segments, syntax
from inkfathom.plans.core_queries import DETECTOR, ES, INTERCEPT, LOO, LP, OB, QUERIES, SQL, SV, SURFACE_SQL, es, model, query, r6, sentences, sv
from inkfathom.session import table

_WS = r"[\s\x0b\p{Z}\x{85}]"
_ABBR = "|".join(segments.ABBREVIATIONS)


def sentence_sql(source: str) -> str:
    """SQL of the relations pg(k, p, pstart, pt) and st(k, n, text): paragraphs and sentences of ``source`` (k, text). Guarded full
    stops are masked, stops with white space behind them cut the paragraph into pieces, and pieces are put together again
    where the next one goes on in lower case on the same line."""
    trim = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
    masked = f"regexp_replace(regexp_replace(regexp_replace(pt, '(?i)(^|[^\\p{{L}}.])({_ABBR})\\.', '\\1\\2\x01', 'g'), '(^|[^\\p{{L}}.])((?:[A-Za-z]\\.)+[A-Za-z])\\.', '\\1\\2\x01', 'g'), '(^|[^\\p{{L}}])(\\p{{Lu}})\\.', '\\1\\2\x01', 'g')"
    return f"""pg AS (SELECT k, generate_subscripts(ps, 1) AS p, unnest(ps) AS pt FROM (SELECT k, list_filter(list_transform(regexp_split_to_array(text, '\\n{_WS}*\\n'), lambda x: {trim("x")}), lambda x: x <> '') AS ps FROM ({source}))),
pc AS (SELECT k, p, string_split(regexp_replace({masked}, '([.!?…]+["''”’)\\]]*)({_WS})', '\\1\x02\\2', 'g'), '\x02') AS c FROM pg),
pj AS (SELECT k, p, array_to_string(list_transform(c, lambda x, i: CASE WHEN i = 1 THEN x WHEN regexp_matches(x, '^{_WS}*\\n') OR NOT regexp_matches(x, '^{_WS}+\\p{{Ll}}') THEN '\x03' || x ELSE x END), '') AS j FROM pc),
pu AS (SELECT k, p, unnest(list_filter(list_transform(string_split(replace(j, '\x01', '.'), '\x03'), lambda x: {trim("x")}), lambda x: x <> '')) AS text, generate_subscripts(list_filter(list_transform(string_split(replace(j, '\x01', '.'), '\x03'), lambda x: {trim("x")}), lambda x: x <> ''), 1) AS i FROM pj),
st AS (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY p, i) - 1)::INT AS n, text FROM pu)"""


_DOCS = "SELECT doc_id AS k, text FROM documents WHERE text IS NOT NULL"


@query("t1_paragraphs", f"WITH {sentence_sql(_DOCS)}\n--\nSELECT k AS doc_id, (p - 1)::INT AS paragraph_index, md5(pt) AS digest, true AS aligned FROM pg")
def _(s, d):
    t = table(s, d, "documents").select("doc_id", "text")
    p = segments.paragraphs(t, ["doc_id"]).join(t.select("doc_id", F.col("text").alias("whole")), "doc_id")
    return p.select("doc_id", "paragraph_index", F.md5("text").alias("digest"), (F.expr("substring(whole, char_start + 1, char_end - char_start)") == F.col("text")).alias("aligned"))


@query("t2_t6_sentences", f"WITH {sentence_sql(_DOCS)}\n--\nSELECT k AS doc_id, n AS sentence_index, text, true AS aligned FROM st")
def _(s, d):
    t = table(s, d, "documents").select("doc_id", "text")
    p = segments.sentences(t, ["doc_id"]).join(t.select("doc_id", F.col("text").alias("whole")), "doc_id")
    return p.select("doc_id", "sentence_index", "text", (F.expr("substring(whole, char_start + 1, char_end - char_start)") == F.col("text")).alias("aligned"))


@query("t8_word_spans", f"WITH w AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[^\\s\\x0b\\p{{Z}}\\x{{85}}]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\\s\\x0b\\p{{Z}}\\x{{85}}]+'), 1) - 1 AS i FROM documents)\n--\nSELECT doc_id, count(*) AS words, min(w) AS first, max(w) AS last, sum(length(w))::BIGINT AS letters, true AS aligned FROM w WHERE i >= 3 GROUP BY doc_id")
def _(s, d):
    t = table(s, d, "documents").select("doc_id", "text")
    w = segments.words(t, ["doc_id"]).join(t.select("doc_id", F.col("text").alias("whole")), "doc_id")
    aligned = F.expr("substring(whole, char_start + 1, char_end - char_start)") == F.col("text")
    return w.groupBy("doc_id").agg(F.count("*").alias("words"), F.min("text").alias("first"), F.max("text").alias("last"), F.sum(F.col("char_end") - F.col("char_start")).cast("bigint").alias("letters"), F.bool_and(aligned).alias("aligned"))


# --- flagship: text to document bands ------------------------------------------------------------------------------
_SEGMENTED = sentence_sql("SELECT id AS k, text FROM es WHERE text IS NOT NULL")
_PARTS = ", ".join(f"{p['coef']}::DOUBLE * CASE WHEN {n} IS NULL THEN 0 ELSE least(greatest(({n} - {p['mean']}::DOUBLE) / {p['scale']}::DOUBLE, -5), 5) END AS {n}" for n, p in DETECTOR.items())
_ROUNDED = ", ".join(f"CASE WHEN n_words >= 4 THEN round({c} + 3e-10, 6) + 0.0 END AS {c}" for c in ["n_words", *DETECTOR])
FLAGSHIP_SQL = f"""WITH {ES}, {_SEGMENTED}, src AS (SELECT k AS k1, n AS k2, text FROM st), f AS ({SURFACE_SQL.replace(chr(92) * 2, chr(92))}), o AS (SELECT k1, k2, {_ROUNDED} FROM f), c AS (SELECT k1, k2, n_words, {_PARTS} FROM o),
sp AS (SELECT k1, k2, greatest(coalesce(n_words, 0), 1) AS w, n_words, 1 / (1 + exp(-least(greatest({INTERCEPT}::DOUBLE + {' + '.join(DETECTOR)}, -30), 30))) AS p FROM c),
dd AS (SELECT k1 AS doc_id, sum(p * w) / sum(w) AS mean_p, max(p) AS max_p, count(n_words) AS measured, count(*) AS sentences FROM sp GROUP BY k1)
SELECT doc_id, sentences, round(mean_p + 3e-10, 6) + 0.0 AS mean_p, round(max_p + 3e-10, 6) + 0.0 AS max_p, CASE WHEN measured = 0 THEN 'unmeasurable' WHEN mean_p >= 0.8948 THEN 'likely_machine' WHEN mean_p <= 0.0598 THEN 'no_evidence' ELSE 'insufficient' END AS band FROM dd"""


def flagship(s, d):
    """Essay texts to sentences, surface features, explained scores, document verdicts and bands."""
    cut = segments.sentences(es(s, d).select(F.col("id").alias("doc_id"), "text"), ["doc_id"]).select("doc_id", "sentence_index", "text")
    f = r6(features.surface_features(cut))
    logit = F.lit(INTERCEPT) + sum(document.contributions(DETECTOR).values(), F.lit(0.0))
    scored = f.select("doc_id", "n_words", document.sigmoid(logit).alias("probability"))
    words = F.greatest(F.coalesce("n_words", F.lit(0.0)), F.lit(1.0))
    docs = scored.groupBy("doc_id").agg(F.count("*").alias("sentences"), (F.sum(F.col("probability") * words) / F.sum(words)).alias("mean_p"), F.max("probability").alias("max_p"), F.count("n_words").alias("measured"))
    return r6(docs.select("doc_id", "sentences", "mean_p", "max_p", document.band(F.col("mean_p"), F.col("measured") > 0, F.lit(True)).alias("band")))


QUERIES["flagship"], SQL["flagship"] = flagship, FLAGSHIP_SQL


# --- observer families ---------------------------------------------------------------------------------------------
FW = "fw AS (SELECT b, count(*) AS n_next, sum(p * ln(p)) AS mu, sum(p * ln(p) * ln(p)) AS q FROM (SELECT b, w, c / sum(c) OVER (PARTITION BY b)::DOUBLE AS p FROM bi) GROUP BY b)"


@query("o1_o3_followers", f"WITH {LP}, {FW}\n--\nSELECT b, n_next, mu, greatest(q - mu * mu, 0) AS sigma2, -mu AS entropy FROM fw", "mu sigma2 entropy")
def _(s, d):
    return ngram.followers(model(s, d))


def _z_sql(value: str, name: str) -> str:
    src = f"WITH {OB}, ft AS (SELECT k1 AS doc_id, k2 AS sentence_index, CASE WHEN count(*) >= 5 THEN round(avg(logprob) + 3e-10, 6) END AS lp, CASE WHEN count(*) >= 5 THEN round((avg(logprob) - avg(mu)) / sqrt(greatest(avg(sigma2), 1e-9)) + 3e-10, 6) END AS cv FROM op GROUP BY k1, k2), src AS (SELECT doc_id, sentence_index, {value} AS x FROM ft), cnt AS (SELECT doc_id, count(*) AS k FROM src GROUP BY doc_id), {LOO}"
    return f"{src}\n--\nSELECT s.doc_id, s.sentence_index, CASE WHEN k < 5 OR s.x IS NULL OR n < 3 THEN NULL WHEN mad >= 1e-9 THEN least(greatest((md.x - m) / mad, -6), 6) WHEN sd >= 1e-9 THEN least(greatest((md.x - m) / sd, -6), 6) WHEN abs(md.x - m) < 1e-9 THEN 0.0 ELSE 6 * sign(md.x - m) END AS {name} FROM src s JOIN cnt USING (doc_id) LEFT JOIN md ON s.doc_id = md.doc_id AND s.sentence_index = md.sentence_index"


def _observer_rows(s, d):
    v = sv(s, d).where("text IS NOT NULL").select(F.col("doc_id").alias("k1"), F.col("sentence_index").alias("k2"), "text")
    f = r6(features.observer_features(ngram.observe(v, ["k1", "k2"], model(s, d)), ["k1", "k2"]))
    return f.select(F.col("k1").alias("doc_id"), F.col("k2").alias("sentence_index"), "mean_logprob", "curvature")


_LAST = "(SELECT DISTINCT doc_id, sentence_index, text FROM sentence_verdicts)"
for _name, _value, _column in (("f38_logprob_z", "lp", "logprob_z_in_doc"), ("f39_curvature_z", "cv", "curvature_z_in_doc")):
    _sql = _z_sql(_value, _column).replace(_LAST, "(SELECT doc_id, sentence_index, text FROM sv WHERE text IS NOT NULL)")
    query(_name, _sql.replace("WITH rw AS", f"WITH {SV}, rw AS", 1), _column)(lambda s, d, c=_column: context.context_features(_observer_rows(s, d)).select("doc_id", "sentence_index", c))


@query("o6_two_model_ratio", f"WITH {LP}, xe AS (SELECT b, -sum(c / d::DOUBLE * ln(q)) AS xent FROM (SELECT b, w, c, sum(c) OVER (PARTITION BY b) AS d FROM bi) JOIN (SELECT w, (c + 1) / (total_tokens + vocab_size)::DOUBLE AS q FROM uni, meta) USING (w) GROUP BY b)\n--\nSELECT k1, k2, avg(xent) AS xent, avg(-logprob) / nullif(avg(xent), 0) AS ratio FROM lp LEFT JOIN xe ON lp.b = xe.b GROUP BY k1, k2 HAVING count(*) >= 5", "xent ratio")
def _(s, d):
    return ngram.two_model_ratio(sentences(s, d), ["k1", "k2"], model(s, d))


@query("f41_w2_w3_style_gap")
def _(s, d):
    """All style keys: those of the text, of the observer and of the reference."""
    v = sv(s, d).where("text IS NOT NULL").select(F.col("doc_id").alias("k1"), F.col("sentence_index").alias("k2"), "text")
    m, keys = model(s, d), ["k1", "k2"]
    x = features.surface_features(v).join(features.observer_features(ngram.observe(v, keys, m), keys), keys, "left").join(ngram.corpus_features(v, keys, m), keys, "left")
    x = x.select(F.col("k1").alias("doc_id"), F.col("k2").alias("sentence_index"), *L.STYLE_KEYS)
    return context.context_features(x).select("doc_id", "sentence_index", "style_gap_from_doc")


@query("j2_words_of_tokens", f"""WITH {LP}, {FW}, rk AS (SELECT w, rank() OVER (ORDER BY c DESC) AS r FROM uni), tk AS (SELECT k1, k2, pos * 6 AS cs, logprob, coalesce(r, 1048576) AS r FROM lp LEFT JOIN rk USING (w)), wd AS (SELECT DISTINCT k1, k2, floor(pos * 6 / 13)::BIGINT AS word FROM lp)
--
SELECT wd.k1, wd.k2, word, count(*) AS tokens, avg(logprob) AS logprob, ln(greatest(min(r), 1)) AS log_rank FROM wd JOIN tk ON wd.k1 = tk.k1 AND wd.k2 = tk.k2 AND cs + 2 >= word * 13 AND cs + 2 < word * 13 + 13 GROUP BY wd.k1, wd.k2, word""", "logprob log_rank")
def _(s, d):
    m = model(s, d)
    ranks = m["uni"].select("w", F.rank().over(W.orderBy(F.desc("c"))).alias("rank"))
    t = ngram.token_logprobs(sentences(s, d), ["k1", "k2"], m).join(F.broadcast(ranks), "w", "left").withColumn("rank", F.coalesce("rank", F.lit(1 << 20)))
    # Tokens take six characters each here, words thirteen: a token belongs to the word that holds its centre.
    start = (F.col("pos") + 1) * 6
    t = t.select("k1", "k2", start.alias("char_start"), (start + 4).alias("char_end"), "logprob", "rank")
    words = t.select("k1", "k2", F.floor(F.col("char_start") / 13).alias("word")).distinct().select("*", (F.col("word") * 13).alias("start"), (F.col("word") * 13 + 13).alias("end"))
    return consensus.word_scores(t, words, ["k1", "k2"])


CONSENSUS_SQL = f"""WITH {SV}, bs AS (SELECT source_id, doc_id || ':' || sentence_index AS word, least(greatest(coalesce(probability, 0.5), 1e-6), 1 - 1e-6)::DOUBLE AS p, coalesce(n_words, 1) AS n FROM sv WHERE source_id IS NOT NULL),
ow AS (SELECT source_id, word, [ln(p), ln(1 - p), ln(p) / 2] AS l, [ln(1 + n % 7), ln(1 + n % 3), ln(1 + n % 2)] AS r FROM bs WHERE n % 5 > 0),
wd AS (SELECT source_id, word, l, list_avg(l) AS m, list_stddev_pop(l) AS sd, list_min(l) AS lo, list_max(l) AS hi, list_avg(r) AS mr, list_stddev_pop(r) AS rsd, list_max(r) <= 1e-9 AS all_first, list_min(r) <= 1e-9 AS any_first FROM ow)
--
SELECT source_id, avg(all_first::INT) AS x_consensus_top1, avg(any_first::INT) AS x_any_top1, avg((NOT any_first)::INT) AS x_no_top1, avg(sd) AS x_spread_lp, stddev_pop(sd) AS x_spread_lp_sd, avg(hi - lo) AS x_range_lp, avg(rsd) AS x_spread_rank, avg((hi - lo > ln(100))::INT) AS x_hard_disagree,
 -avg(m) / greatest(avg(sd), 1e-6) AS x_binoc, avg(mr) / greatest(avg(rsd), 1e-6) AS x_binoc_rank, avg(lo) AS x_min_lp, avg(hi) AS x_max_lp, avg(hi - m) AS x_best_gap, count(*)::DOUBLE AS x_n_words,
 (coalesce(CASE WHEN stddev_pop(l[1]) > 1e-9 AND stddev_pop(l[2]) > 1e-9 THEN corr(l[1], l[2]) END, 0) + coalesce(CASE WHEN stddev_pop(l[1]) > 1e-9 THEN 1.0 END, 0) + coalesce(CASE WHEN stddev_pop(l[2]) > 1e-9 AND stddev_pop(l[3]) > 1e-9 THEN corr(l[2], l[3]) END, 0)) / 3 AS x_corr_lp FROM wd GROUP BY source_id HAVING count(*) >= 30"""


@query("a38_j14_consensus", CONSENSUS_SQL, "x_consensus_top1 x_any_top1 x_no_top1 x_spread_lp x_spread_lp_sd x_range_lp x_spread_rank x_hard_disagree x_binoc x_binoc_rank x_min_lp x_max_lp x_best_gap x_corr_lp")
def _(s, d):
    return consensus.features(consensus.observers(sv(s, d).where("source_id IS NOT NULL")), ["source_id"])


# --- structure over a parse made in the query ----------------------------------------------------------------------
PARSE_SQL = """pr AS (SELECT p_partkey % 40 AS d, p_partkey % 400 // 40 AS s, p_partkey AS i, p_size, p_name FROM part), ps AS (SELECT 'd' || d AS doc_id, s::INT AS sentence_index, (row_number() OVER (PARTITION BY d, s ORDER BY i) - 1)::INT AS i, count(*) OVER (PARTITION BY d, s) AS n, p_size FROM pr),
parse AS (SELECT doc_id, sentence_index, i, CASE WHEN i = 0 THEN 0 ELSE (i - 1 - p_size % least(i, 3))::INT END AS head, CASE p_size % 6 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' WHEN 2 THEN 'DET' WHEN 3 THEN 'ADJ' WHEN 4 THEN 'ADP' ELSE 'PRON' END AS pos, p_size % 3 = 0 AS is_stop, p_size % 11 = 10 AS is_punct FROM ps)"""


def parse(s, d):
    """A parse table from the parts table: each token hangs from one of the three before it."""
    w = W.partitionBy("d", "s").orderBy("p_partkey")
    p = table(s, d, "part").select((F.col("p_partkey") % 40).alias("d"), F.floor(F.col("p_partkey") % 400 / 40).cast("int").alias("s"), "p_partkey", "p_size")
    p = p.withColumn("i", F.row_number().over(w) - 1)
    tag = F.element_at(F.array(*map(F.lit, ("NOUN", "VERB", "DET", "ADJ", "ADP", "PRON"))), (F.col("p_size") % 6 + 1).cast("int"))
    head = F.when(F.col("i") == 0, 0).otherwise((F.col("i") - 1 - F.col("p_size") % F.least("i", F.lit(3))).cast("int"))
    return p.select(F.concat(F.lit("d"), F.col("d")).alias("doc_id"), F.col("s").alias("sentence_index"), "i", head.alias("head"), tag.alias("pos"), (F.col("p_size") % 3 == 0).alias("is_stop"), (F.col("p_size") % 11 == 10).alias("is_punct"))


_STRUCTURE = f"""WITH RECURSIVE {PARSE_SQL}, dp AS (SELECT doc_id, sentence_index, i, 0 AS depth FROM parse WHERE head = i UNION ALL SELECT p.doc_id, p.sentence_index, p.i, dp.depth + 1 FROM parse p JOIN dp ON p.doc_id = dp.doc_id AND p.sentence_index = dp.sentence_index AND p.head = dp.i AND p.head <> p.i),
re AS (SELECT p.*, depth, lag(pos, 2) OVER o AS a, lag(pos, 1) OVER o AS b FROM parse p JOIN dp USING (doc_id, sentence_index, i) WHERE NOT is_punct WINDOW o AS (PARTITION BY doc_id, sentence_index ORDER BY i)),
ba AS (SELECT doc_id, sentence_index, max(depth)::DOUBLE AS tree_depth_max, avg(depth) AS tree_depth_mean, stddev_samp(depth) AS tree_depth_sd, avg(is_stop::INT) AS stopword_ratio, sum((pos IN ('NOUN', 'PROPN', 'VERB', 'ADJ', 'ADV'))::INT) / nullif(sum((pos NOT IN ('NOUN', 'PROPN', 'VERB', 'ADJ', 'ADV'))::INT), 0)::DOUBLE AS content_function_ratio FROM re GROUP BY ALL HAVING count(*) >= {syntax.MIN_TOKENS}),
ch AS (SELECT doc_id, sentence_index, avg(n) AS branching_factor FROM (SELECT p.doc_id, p.sentence_index, p.head, count(*) AS n FROM parse p JOIN parse q ON p.doc_id = q.doc_id AND p.sentence_index = q.sentence_index AND p.head = q.i AND NOT q.is_punct WHERE p.head <> p.i GROUP BY ALL) GROUP BY ALL),
tr AS (SELECT doc_id, sentence_index, count(*) AS n FROM re WHERE a IS NOT NULL GROUP BY doc_id, sentence_index, a, b, pos), en AS (SELECT doc_id, sentence_index, -sum(n / t::DOUBLE * log2(n / t::DOUBLE)) AS pos_trigram_entropy FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, sentence_index) AS t FROM tr) GROUP BY ALL)
--
SELECT doc_id, sentence_index, tree_depth_max, tree_depth_mean, tree_depth_sd, stopword_ratio, content_function_ratio, branching_factor, pos_trigram_entropy FROM ba LEFT JOIN ch USING (doc_id, sentence_index) LEFT JOIN en USING (doc_id, sentence_index)"""


@query("x1_x7_structure", _STRUCTURE, "tree_depth_max tree_depth_mean tree_depth_sd stopword_ratio content_function_ratio branching_factor pos_trigram_entropy")
def _(s, d):
    return syntax.structure(parse(s, d)).withColumn("tree_depth_max", F.col("tree_depth_max").cast("double"))


TAGS_SQL = f"""{PARSE_SQL}, tg AS (SELECT doc_id, sentence_index, list_concat(list_concat(['<s>', '<s>'], list(pos ORDER BY i)), ['</s>']) AS l FROM parse GROUP BY ALL), tk AS (SELECT doc_id, sentence_index, unnest(l) AS c, generate_subscripts(l, 1) AS k FROM tg), tx AS (SELECT *, lag(c, 1) OVER o AS b, lag(c, 2) OVER o AS a FROM tk WINDOW o AS (PARTITION BY doc_id, sentence_index ORDER BY k)),
hu AS (SELECT * FROM tx WHERE sentence_index % 2 = 0), u1 AS (SELECT c, count(*) AS n FROM hu GROUP BY c), u2 AS (SELECT b, c, count(*) AS n FROM hu WHERE b IS NOT NULL GROUP BY ALL), u3 AS (SELECT a, b, c, count(*) AS n FROM hu WHERE a IS NOT NULL GROUP BY ALL), tt AS (SELECT sum(n) AS total, sum((c NOT IN ('<s>', '</s>'))::INT) AS kinds FROM u1),
su AS (SELECT x.doc_id, x.sentence_index, avg(-log2(CASE WHEN u3.n > 0 AND d3.n > 0 THEN u3.n / d3.n::DOUBLE WHEN u2.n > 0 AND d2.n > 0 THEN 0.4::DOUBLE * u2.n / d2.n WHEN u1.n > 0 THEN 0.4::DOUBLE * 0.4::DOUBLE * u1.n / total ELSE 0.064::DOUBLE / greatest(kinds, 1) END)) AS pos_trigram_surprisal FROM tx x CROSS JOIN tt LEFT JOIN u3 ON x.a = u3.a AND x.b = u3.b AND x.c = u3.c LEFT JOIN u2 d3 ON x.a = d3.b AND x.b = d3.c LEFT JOIN u2 ON x.b = u2.b AND x.c = u2.c LEFT JOIN u1 d2 ON x.b = d2.c LEFT JOIN u1 ON x.c = u1.c WHERE x.k >= 3 GROUP BY ALL)"""


@query("x8_x12_tag_surprisal", f"WITH {TAGS_SQL}\n--\nSELECT doc_id, sentence_index, pos_trigram_surprisal FROM su", "pos_trigram_surprisal")
def _(s, d):
    p = parse(s, d)
    return syntax.tag_surprisal(p, syntax.tag_model(p.where("sentence_index % 2 = 0")))


@query("x9_x11_structure_context", f"WITH {TAGS_SQL}, src AS (SELECT doc_id, sentence_index, round(pos_trigram_surprisal + 3e-10, 6) AS x FROM su), cnt AS (SELECT doc_id, count(*) AS k FROM src GROUP BY doc_id), {LOO}\n--\nSELECT s.doc_id, s.sentence_index, CASE WHEN k < 5 OR s.x IS NULL OR n < 3 THEN NULL WHEN mad >= 1e-9 THEN least(greatest((md.x - m) / mad, -6), 6) WHEN sd >= 1e-9 THEN least(greatest((md.x - m) / sd, -6), 6) WHEN abs(md.x - m) < 1e-9 THEN 0.0 ELSE 6 * sign(md.x - m) END AS pos_surprisal_z_in_doc, CASE WHEN k >= 5 AND count(s.x) OVER w >= 3 AND avg(s.x) OVER w >= 1e-9 THEN stddev_samp(s.x) OVER w / avg(s.x) OVER w END AS local_depth_burstiness FROM src s JOIN cnt USING (doc_id) LEFT JOIN md ON s.doc_id = md.doc_id AND s.sentence_index = md.sentence_index WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.sentence_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "pos_surprisal_z_in_doc local_depth_burstiness")
def _(s, d):
    p = parse(s, d)
    x = r6(syntax.tag_surprisal(p, syntax.tag_model(p.where("sentence_index % 2 = 0"))))
    return syntax.context(x.withColumn("tree_depth_max", F.col("pos_trigram_surprisal"))).select("doc_id", "sentence_index", "pos_surprisal_z_in_doc", "local_depth_burstiness")


@query("o5_tiled_tokens", "SELECT s_suppkey, true AS covered, 3 AS tokens FROM supplier")
def _(s, d):
    names = table(s, d, "supplier").select("s_suppkey", "s_name")

    def run(parts):
        import pandas as pd

        for part in parts:
            # Candidates in order, two of which do not belong: the covering leaves them out.
            spans = [segments.tile(n, [n[:4], "zz", n[4:9], n[5:9], n[9:]]) for n in part["s_name"]]
            yield pd.DataFrame({"s_suppkey": part["s_suppkey"], "covered": [bool(x) and all(a[1] == b[0] for a, b in zip(x, x[1:], strict=False)) for x in spans], "tokens": [len(x or []) for x in spans]})

    return names.mapInPandas(run, "s_suppkey bigint, covered boolean, tokens int")
