"""Core queries and their SQL. A name starts with the inventory's group and number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfathom.functions import lexicons as L
from inkfathom.functions import text as X
from inkfathom.operators import context, corpus, document, features, metrics, ngram
from inkfathom.session import table
from inkfathom.streaming import limiter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SHIFT = 3e-10


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits, without negative zeros; the shift keeps exact halves from turning on the order of a sum."""
    return df.select(*((F.round(F.col(c) + SHIFT, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None, rounded: str = ""):
    """Registers a query; ``rounded`` names the double columns of ``sql``."""

    def add(f: Query) -> Query:
        QUERIES[name] = lambda s, d: r6(f(s, d))
        if sql:
            r = ", ".join(f"round({c} + {SHIFT}, 6) + 0.0 AS {c}" for c in rounded.split())
            with_, _, rest = ("", "", sql) if not sql.startswith("WITH ") else sql.rpartition("\n--\n")
            SQL[name] = f"{with_}\nSELECT * {f'REPLACE ({r})' if r else ''} FROM ({rest})" if rounded else sql.replace("\n--\n", "\n")
        return f

    return add


SV = """sv AS (SELECT * EXCLUDE (probability, smoothed, _r), nullif(probability, 'NaN'::DOUBLE) AS probability, nullif(smoothed, 'NaN'::DOUBLE) AS smoothed FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_index
  ORDER BY scored_at DESC NULLS LAST, probability DESC NULLS LAST, char_start, char_end, smoothed DESC NULLS LAST, n_words DESC NULLS LAST) AS _r FROM sentence_verdicts) WHERE _r = 1)"""
ES = """es AS (SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, sha256 NULLS FIRST, text NULLS FIRST) AS _r FROM essays WHERE id IS NOT NULL) WHERE _r = 1)"""
SC = f"""{SV}, {ES}, sc AS (SELECT sv.*, es.source_id AS source, es.authorship, lower(trim(es.role)) AS role, CASE es.authorship WHEN 'human' THEN 0 WHEN 'machine' THEN 1 WHEN 'hybrid' THEN 1 END AS label FROM sv JOIN es ON sv.doc_id = es.id)"""
WORDS = "regexp_extract_all(lower(text), '[A-Za-zÀ-ɏ'']+')"


def sv(s: SparkSession, d: str) -> DataFrame:
    return document.latest_verdicts(table(s, d, "sentence_verdicts"))


def es(s: SparkSession, d: str) -> DataFrame:
    return corpus.one_per_id(table(s, d, "essays"))


def sc(s: SparkSession, d: str) -> DataFrame:
    """Sentences with their essay's source, role and label."""
    e = es(s, d).select(F.col("id").alias("doc_id"), F.col("source_id").alias("source"), "authorship", F.lower(F.trim("role")).alias("role"), corpus.label(F.col("authorship")).alias("label"))
    return sv(s, d).drop("source_id").join(e, "doc_id")


def docs_scored(s: SparkSession, d: str) -> DataFrame:
    """Documents with their statistics and label."""
    return document.statistics(sv(s, d)).join(es(s, d).select(F.col("id").alias("doc_id"), F.col("source_id").alias("source"), F.lower(F.trim("role")).alias("role"), corpus.label(F.col("authorship")).alias("label")), "doc_id")


DS = f"""{SC}, st AS (SELECT doc_id, sum(probability * greatest(coalesce(n_words, 0), 1)) / sum(greatest(coalesce(n_words, 0), 1))::DOUBLE AS mean_p, max(probability) AS max_p, quantile_cont(probability, 0.9) AS q90_p,
  sum(CASE WHEN probability >= 0.3004 THEN coalesce(n_words, 0) ELSE 0 END)::DOUBLE / greatest(sum(coalesce(n_words, 0)), 1)::DOUBLE AS share, ln(1 + count(*)::DOUBLE) AS log_sentences FROM sv WHERE reliable AND probability IS NOT NULL GROUP BY doc_id),
ds AS (SELECT st.*, es.source_id AS source, lower(trim(es.role)) AS role, CASE es.authorship WHEN 'human' THEN 0 WHEN 'machine' THEN 1 WHEN 'hybrid' THEN 1 END AS label FROM st JOIN es ON st.doc_id = es.id)"""


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


# --- text and surface features -------------------------------------------------------------------------------------
_PH = " + ".join("(contains(lower(text), '" + p.replace("'", "''") + "'))::INT" for p in L.MACHINE_PHRASES)
_RATE = lambda words: f"len(list_filter(w, lambda x: x IN {_in(words)})) * (100.0::DOUBLE / n)"
SURFACE_SQL = f"""SELECT k1, k2, n::DOUBLE AS n_words, list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / n AS mean_word_len, len(list_filter(w, lambda x: length(x) > 6))::DOUBLE / n AS long_word_rate, len(list_distinct(w)) / sqrt(n) AS root_ttr,
 len(regexp_extract_all(text, ',')) * (100.0::DOUBLE / n) AS comma_rate, len(list_distinct(regexp_extract_all(text, '[,;:—–\\-()"''!?.]')))::DOUBLE AS punct_variety,
 len(regexp_extract_all(replace(text, ' ', '  '), '[—–]| -{{1,2}} ')) * (100.0::DOUBLE / n) AS em_dash_rate,
 {_RATE(L.CLAUSE_MARKERS)} AS subordination_rate, {_RATE(L.FUNCTION_WORDS)} AS function_word_rate, ({_PH}) * (100.0::DOUBLE / n) AS machine_phrase_rate, {_RATE(L.MACHINE_WORDS)} AS machine_word_rate, {_RATE(L.HEDGES)} AS hedge_rate,
 {_RATE(L.BOOSTERS)} AS booster_rate, {_RATE(L.DISCOURSE)} AS discourse_marker_rate, {_RATE(L.FIRST_PERSON)} AS first_person_rate,
 len(regexp_extract_all(text, '(?i)[\\p{{L}}\\p{{M}}\\p{{N}}_]+[''’](?:s|t|re|ve|ll|d|m)(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')) * (100.0::DOUBLE / n) AS contraction_rate,
 (len(list_filter(string_split(text, ' '), lambda x, i: i > 1 AND regexp_matches(x, '^[A-Z][a-z]{{2,}}') AND regexp_matches(string_split(text, ' ')[i - 1], '[a-z,;]$'))) + len(regexp_extract_all(text, '\\p{{Nd}}')) + len(list_filter(w, lambda x: x IN {_in(L.CONCRETE)}))) * (100.0::DOUBLE / n) AS specificity_rate,
 (regexp_matches(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_''’]+(?:[\\s\\p{{Z}}]+[\\p{{L}}\\p{{M}}\\p{{N}}_''’]+){{0,3}},[\\s\\p{{Z}}]+[\\p{{L}}\\p{{M}}\\p{{N}}_''’]+(?:[\\s\\p{{Z}}]+[\\p{{L}}\\p{{M}}\\p{{N}}_''’]+){{0,3}},[\\s\\p{{Z}}]+and[\\s\\p{{Z}}]+'))::INT::DOUBLE AS tricolon,
 (regexp_matches(text, '(?is)\\bnot (?:just|only|merely|simply)\\b.{{0,80}}?\\bbut\\b|\\bwas ?n[o''’]t\\b.{{0,60}}?\\bit was\\b|\\bmore than (?:just )?a\\b'))::INT::DOUBLE AS antithesis
 FROM (SELECT *, {WORDS} AS w, len({WORDS}) AS n FROM src)"""


def _surface_sql(source: str) -> str:
    cols = ", ".join(f"CASE WHEN n_words >= 4 THEN round({c} + {SHIFT}, 6) + 0.0 END AS {c}" for c in features.SURFACE)
    return f"WITH src AS ({source}), f AS ({SURFACE_SQL.replace(chr(92) * 2, chr(92))})\nSELECT k1, k2, {cols} FROM f"


SQL["f15_f33_surface_sentences"] = _surface_sql("SELECT doc_id AS k1, sentence_index AS k2, text FROM (SELECT DISTINCT doc_id, sentence_index, text FROM sentence_verdicts) WHERE text IS NOT NULL")
QUERIES["f15_f33_surface_sentences"] = lambda s, d: r6(features.surface_features(table(s, d, "sentence_verdicts").where("text IS NOT NULL").select(F.col("doc_id").alias("k1"), F.col("sentence_index").alias("k2"), "text").distinct()).select("k1", "k2", *features.SURFACE))


@query("n1_s3_records", None)
def _(s, d):
    return corpus.records(table(s, d, "documents").where("text IS NOT NULL")).select("doc_id", "n_words", "sha256")


SQL["n1_s3_records"] = r"""SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '\s+')) END AS n_words, sha256(t) AS sha256 FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(translate(replace(replace(text, E'\r\n', E'\n'), E'\r', E'\n'), '""" + "".join(L.TYPOGRAPHY_ONE).replace("'", "''") + L.ZERO_WIDTH + "', '" + "".join(L.TYPOGRAPHY_ONE.values()).replace("'", "''") + r"""'), '[–—―]', ' - ', 'g'), '…', '...'), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL)"""


@query("t1_paragraph_counts", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n[\s\x0b]*\n'), lambda x: trim(x, E' \t\n\r\x0b\f') <> '')) AS paragraphs FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(F.filter(F.split("text", r"\n\s*\n"), lambda x: F.regexp_replace(x, r"\s+", "") != "")).cast("bigint").alias("paragraphs"))


@query("t7_word_counts", f"SELECT doc_id, len({WORDS}) AS words, len(list_distinct({WORDS})) AS different FROM documents WHERE text IS NOT NULL")
def _(s, d):
    w = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.array(X.words(F.col("text")))).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("words"), F.size(F.array_distinct("w")).cast("bigint").alias("different"))


@query("flt_p1_flatten", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[\s\x0b]*\n+[\s\x0b]*', ' ', 'g'), '^[\s\x0b]+|[\s\x0b]+$', '', 'g')) AS flat FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(X.flatten(F.col("text"))).alias("flat"))


@query("n3_slugs", "SELECT s_suppkey, left(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS slug FROM supplier")
def _(s, d):
    return table(s, d, "supplier").select("s_suppkey", X.slug(F.col("s_name")).alias("slug"))


@query("n7_flt_p15_hash_half", "SELECT id, (('0x' || left(sha256('frontier:' || id), 8))::BIGINT % 2)::BIGINT AS half, sha256('m' || chr(0) || text) AS cache_key FROM (SELECT DISTINCT id, text FROM essays)")
def _(s, d):
    e = table(s, d, "essays").select("id", "text").distinct()
    return e.select("id", X.hash_half(F.col("id"), "frontier").alias("half"), F.sha2(F.concat(F.lit("m\0"), F.col("text")), 256).alias("cache_key"))


@query("n9_n12_math", "SELECT l_orderkey, l_linenumber, ln(p / (1 - p)) AS logit, 1 / (1 + exp(-least(greatest(l_quantity - 25, -30), 30))) AS sig, round_even(l_extendedprice / 7, 2) AS half_even, (y0 + (y1 - y0) * (x - k)) AS interp FROM (SELECT *, k / 200.0::DOUBLE AS y0, least(k + 1, 200) / 200.0::DOUBLE AS y1 FROM (SELECT *, least(greatest(l_discount, 1e-9), 1 - 1e-9) AS p, l_discount * 200 AS x, floor(l_discount * 200) AS k FROM lineitem))", "logit sig half_even interp")
def _(s, d):
    l = table(s, d, "lineitem")
    p = F.least(F.greatest("l_discount", F.lit(1e-9)), F.lit(1 - 1e-9))
    x = F.col("l_discount") * 200
    k = F.floor(x)
    y0, y1 = k / 200, F.least(k + 1, F.lit(200)) / 200
    return l.select("l_orderkey", "l_linenumber", F.log(p / (1 - p)).alias("logit"), document.sigmoid(F.col("l_quantity") - 25).alias("sig"), F.bround(F.col("l_extendedprice") / 7, 2).alias("half_even"), (y0 + (y1 - y0) * (x - k)).alias("interp"))


@query("n14_n15_arrays", "SELECT vec_id, list_dot_product(embedding::DOUBLE[], list_transform(embedding, lambda x, i: (i % 3)::DOUBLE)) AS dot, len(list_distinct(embedding)) AS different, list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)) AS head FROM embeddings", "dot head")
def _(s, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    dot = F.aggregate(F.transform(v, lambda x, i: x * ((i + 1) % 3)), F.lit(0.0), lambda a, x: a + x)
    return table(s, d, "embeddings").select("vec_id", dot.alias("dot"), F.size(F.array_distinct("embedding")).cast("bigint").alias("different"), F.aggregate(F.slice(v, 1, 8), F.lit(0.0), lambda a, x: a + x).alias("head"))


@query("n16_n18_json_null", "SELECT event_id, (props->>'k')::BIGINT AS k, coalesce(nullif((props->>'k')::BIGINT, 0), 1) AS k_or_one, date_trunc('day', ts) AS day, date_diff('second', ts, date_trunc('day', ts) + INTERVAL 1 DAY)::BIGINT AS to_midnight FROM (SELECT *, date_trunc('second', ts) AS _t FROM events)")
def _(s, d):
    e = table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    day = F.date_trunc("day", F.col("ts"))
    return e.select("event_id", k.alias("k"), F.coalesce(F.nullif(k, F.lit(0)), F.lit(1)).alias("k_or_one"), day.cast("timestamp_ntz").alias("day"), (F.unix_timestamp(F.date_add(F.to_date("ts"), 1).cast("timestamp")) - F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)).cast("bigint").alias("to_midnight"))


# --- n-grams and the observer --------------------------------------------------------------------------------------
NG = f"""rw AS (SELECT item_id, generate_subscripts(w, 1) AS pos, unnest(w) AS w0 FROM (SELECT item_id, {WORDS} AS w FROM heldout_items)), vocab AS (SELECT w0 AS v FROM rw GROUP BY w0 HAVING count(*) >= 2), rm AS (SELECT item_id, pos, coalesce(v, '<unk>') AS w FROM rw LEFT JOIN vocab ON w0 = v),
ctx AS (SELECT w, coalesce(lag(w, 1) OVER o, '<s>') AS b, coalesce(lag(w, 2) OVER o, '<s>') AS a FROM rm WINDOW o AS (PARTITION BY item_id ORDER BY pos)), uni AS (SELECT w, count(*) AS c FROM rm GROUP BY w), bi AS (SELECT b, w, count(*) AS c FROM ctx GROUP BY ALL), tri AS (SELECT a, b, w, count(*) AS c FROM ctx GROUP BY ALL),
meta AS (SELECT (SELECT count(*) FROM rm) AS total_tokens, (SELECT count(*) + 1 FROM vocab) AS vocab_size, (SELECT count(*) FROM heldout_items) AS n_documents)"""
LP = f"""{NG}, sw AS (SELECT k1, k2, generate_subscripts(w, 1) AS pos, unnest(w) AS w0 FROM (SELECT doc_id AS k1, sentence_index AS k2, {WORDS} AS w FROM (SELECT DISTINCT doc_id, sentence_index, text FROM sentence_verdicts))), sm AS (SELECT k1, k2, pos, coalesce(u.w, '<unk>') AS w FROM sw LEFT JOIN (SELECT w FROM uni WHERE w <> '<unk>') u ON w0 = u.w),
sx AS (SELECT *, coalesce(lag(w, 1) OVER o, '<s>') AS b, coalesce(lag(w, 2) OVER o, '<s>') AS a FROM sm WINDOW o AS (PARTITION BY k1, k2 ORDER BY pos)),
sp AS (SELECT x.k1, x.k2, x.pos, x.w, x.b, coalesce(t.c, 0) AS c3, coalesce(d3.c, 0) AS d3, coalesce(g.c, 0) AS c2, CASE WHEN x.b = '<s>' THEN n_documents ELSE coalesce(d2.c, 0) END AS d2, (coalesce(u.c, 0) + 1) / (total_tokens + vocab_size)::DOUBLE AS p1
 FROM sx x CROSS JOIN meta LEFT JOIN uni u ON x.w = u.w LEFT JOIN bi g ON x.b = g.b AND x.w = g.w LEFT JOIN tri t ON x.a = t.a AND x.b = t.b AND x.w = t.w LEFT JOIN uni d2 ON x.b = d2.w LEFT JOIN bi d3 ON x.a = d3.b AND x.b = d3.w),
lp AS (SELECT *, ln(greatest(0.5 * p3 + 0.3 * p2 + 0.2 * p1, 1e-12)) AS logprob FROM (SELECT *, CASE WHEN d3 > 0 THEN c3 / d3::DOUBLE ELSE p2 END AS p3 FROM (SELECT *, CASE WHEN d2 > 0 THEN c2 / d2::DOUBLE ELSE p1 END AS p2 FROM sp)))"""


def model(s, d):
    return ngram.fit(table(s, d, "heldout_items"), "item_id")


def sentences(s, d):
    return table(s, d, "sentence_verdicts").select(F.col("doc_id").alias("k1"), F.col("sentence_index").alias("k2"), "text").distinct()


@query("a1_ngram_fit", f"WITH {NG}\n--\nSELECT a, b, w, c FROM tri UNION ALL SELECT NULL, b, w, c FROM bi UNION ALL SELECT NULL, NULL, w, c FROM uni")
def _(s, d):
    m = model(s, d)
    none = F.lit(None).cast("string")
    return m["tri"].select("a", "b", "w", "c").unionAll(m["bi"].select(none, "b", "w", "c")).unionAll(m["uni"].select(none, none, "w", "c"))


@query("f34_f36_a2_j3_corpus_features", f"WITH {LP}\n--\nSELECT k1, k2, CASE WHEN n >= 4 THEN m END AS corpus_surprisal_mean, CASE WHEN n >= 4 THEN sd END AS corpus_surprisal_sd, CASE WHEN n >= 4 THEN novel END AS novel_trigram_rate FROM (SELECT k1, k2, count(*) AS n, avg(-logprob) AS m, stddev_samp(-logprob) AS sd, avg(CASE WHEN pos >= 3 THEN CASE WHEN c3 > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END) AS novel FROM lp GROUP BY k1, k2)", "corpus_surprisal_mean corpus_surprisal_sd novel_trigram_rate")
def _(s, d):
    return ngram.corpus_features(sentences(s, d), ["k1", "k2"], model(s, d))


OB = f"""{LP}, fw AS (SELECT b, count(*) AS n_next, sum(p * ln(p)) AS mu, sum(p * ln(p) * ln(p)) AS q FROM (SELECT b, w, c / sum(c) OVER (PARTITION BY b)::DOUBLE AS p FROM bi) GROUP BY b),
ob AS (SELECT k1, k2, pos, logprob, coalesce(s.r2, coalesce(n_next, 0) + coalesce(r.rank, 1048576)) AS rank, mu, greatest(q - mu * mu, 0) AS sigma2, -mu AS entropy FROM lp LEFT JOIN (SELECT w, rank() OVER (ORDER BY c DESC) AS rank FROM uni) r ON lp.w = r.w LEFT JOIN fw ON lp.b = fw.b LEFT JOIN (SELECT b, w, rank() OVER (PARTITION BY b ORDER BY c DESC) AS r2 FROM bi) s ON lp.b = s.b AND lp.w = s.w),
op AS (SELECT *, lag(logprob) OVER (PARTITION BY k1, k2 ORDER BY pos) AS prev FROM ob)"""
_G = "CASE WHEN n >= 5 THEN {0} END AS {0}"


@query("f1_f14_o7_observer_features", f"""WITH {OB}
--
SELECT k1, k2, {', '.join(_G.format(c) for c in 'mean_logprob logprob_sd logprob_iqr frac_rank_top1 frac_rank_top10 frac_rank_top100 frac_rank_tail mean_log_rank log_rank_sd'.split())}, CASE WHEN n >= 5 THEN mean_entropy END AS mean_entropy, CASE WHEN n >= 5 THEN entropy_sd END AS entropy_sd, CASE WHEN n >= 5 AND mean_log_rank > 0 THEN -mean_logprob / mean_log_rank END AS lrr, CASE WHEN n >= 5 THEN (mean_logprob - mean_mu) / sqrt(greatest(mean_s2, 1e-9)) END AS curvature, CASE WHEN n >= 5 AND n > 3 AND sp > 1e-12 THEN cv / sp END AS surprisal_autocorr
FROM (SELECT k1, k2, count(*) AS n, avg(logprob) AS mean_logprob, stddev_samp(logprob) AS logprob_sd, quantile_cont(logprob, 0.75) - quantile_cont(logprob, 0.25) AS logprob_iqr, avg((rank <= 1)::INT) AS frac_rank_top1, avg((rank <= 10)::INT) AS frac_rank_top10, avg((rank <= 100)::INT) AS frac_rank_top100,
 avg((rank > 1000)::INT) AS frac_rank_tail, avg(ln(greatest(rank, 1))) AS mean_log_rank, stddev_samp(ln(greatest(rank, 1))) AS log_rank_sd, avg(entropy) AS mean_entropy, stddev_samp(entropy) AS entropy_sd, avg(mu) AS mean_mu, avg(sigma2) AS mean_s2, covar_samp(logprob, prev) AS cv, stddev_samp(CASE WHEN prev IS NOT NULL THEN logprob END) * stddev_samp(prev) AS sp FROM op GROUP BY k1, k2)""", " ".join(features.OBSERVER))
def _(s, d):
    return features.observer_features(ngram.observe(sentences(s, d), ["k1", "k2"], model(s, d)), ["k1", "k2"])


@query("s15_packed_bigrams", f"WITH {NG}, ids AS (SELECT w, row_number() OVER (ORDER BY w) AS id FROM (SELECT DISTINCT w FROM uni))\n--\nSELECT (coalesce(x.id, 0) * 65536 + y.id)::BIGINT AS key, bi.c FROM bi LEFT JOIN ids x ON bi.b = x.w JOIN ids y ON bi.w = y.w")
def _(s, d):
    return ngram.packed_keys(model(s, d))


@query("j1_range_join", f"WITH tk AS (SELECT doc_id, char_start AS cs, char_start + 3 AS ce FROM sentence_verdicts), sp AS (SELECT DISTINCT doc_id, char_start, char_end FROM sentence_verdicts)\n--\nSELECT sp.doc_id, sp.char_start, count(cs) AS tokens FROM sp LEFT JOIN tk ON sp.doc_id = tk.doc_id AND (cs + ce) / 2.0 >= sp.char_start AND (cs + ce) / 2.0 < sp.char_end GROUP BY ALL")
def _(s, d):
    v = table(s, d, "sentence_verdicts")
    none = F.lit(None).cast("double")
    tokens = v.select("doc_id", "char_start", (F.col("char_start") + 3).alias("char_end"), F.lit(0).alias("tok_idx"), none.alias("logprob"), none.alias("rank"), none.alias("entropy"), none.alias("mu"), none.alias("sigma2"))
    spans = v.select("doc_id", F.col("char_start").alias("start"), F.col("char_end").alias("end")).distinct()
    return features.tokens_in_spans(tokens, spans).groupBy("doc_id", F.col("start").alias("char_start"), "end").agg(F.count("tok_idx").alias("tokens")).groupBy("doc_id", "char_start").agg(F.sum("tokens").alias("tokens"))


# --- context, smoothing, passages, documents -----------------------------------------------------------------------
@query("f42_f43_w4_w5_position", f"WITH {SV}\n--\nSELECT doc_id, sentence_index, (row_number() OVER o - 1) / greatest(count(*) OVER (PARTITION BY doc_id) - 1, 1)::DOUBLE AS rel_position, CASE WHEN count(n_words) OVER w >= 3 AND avg(n_words) OVER w >= 1e-9 THEN stddev_samp(n_words) OVER w / avg(n_words) OVER w END AS local_len_burstiness FROM sv WINDOW o AS (PARTITION BY doc_id ORDER BY sentence_index), w AS (PARTITION BY doc_id ORDER BY sentence_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "rel_position local_len_burstiness")
def _(s, d):
    return context.relative_position(context.local_burstiness(sv(s, d), F.col("n_words").cast("double"))).select("doc_id", "sentence_index", "rel_position", "local_len_burstiness")


LOO = """z AS (SELECT a.doc_id, a.sentence_index, a.x, median(b.x) AS m, count(b.x) AS n, stddev_samp(b.x) AS sd FROM src a JOIN src b ON a.doc_id = b.doc_id AND a.sentence_index <> b.sentence_index GROUP BY ALL),
md AS (SELECT z.doc_id, z.sentence_index, any_value(z.x) AS x, any_value(m) AS m, any_value(n) AS n, any_value(sd) AS sd, 1.4826 * median(abs(b.x - m)) AS mad FROM z JOIN src b ON z.doc_id = b.doc_id AND z.sentence_index <> b.sentence_index GROUP BY z.doc_id, z.sentence_index)"""


@query("f38_f40_w1_w6_loo_z", f"WITH {SV}, src AS (SELECT doc_id, sentence_index, n_words::DOUBLE AS x FROM sv), cnt AS (SELECT doc_id, count(*) AS k FROM src GROUP BY doc_id), {LOO}\n--\nSELECT s.doc_id, s.sentence_index, CASE WHEN k < 5 OR s.x IS NULL OR n < 3 THEN NULL WHEN mad >= 1e-9 THEN least(greatest((md.x - m) / mad, -6), 6) WHEN sd >= 1e-9 THEN least(greatest((md.x - m) / sd, -6), 6) WHEN abs(md.x - m) < 1e-9 THEN 0.0 ELSE 6 * sign(md.x - m) END AS len_z_in_doc FROM src s JOIN cnt USING (doc_id) LEFT JOIN md ON s.doc_id = md.doc_id AND s.sentence_index = md.sentence_index", "len_z_in_doc")
def _(s, d):
    return context.context_features(sv(s, d).select("doc_id", "sentence_index", "n_words")).select("doc_id", "sentence_index", "len_z_in_doc")


@query("w10_loo_mean_z", f"WITH {SV}, c AS (SELECT doc_id, sentence_index, coalesce(n_words::DOUBLE, avg(n_words) OVER (PARTITION BY doc_id)) AS x FROM sv), e AS (SELECT *, x - avg(x) OVER (PARTITION BY doc_id) AS y, count(*) OVER (PARTITION BY doc_id) - 1 AS n FROM c), f AS (SELECT *, (sum(y) OVER (PARTITION BY doc_id) - y) / nullif(n, 0) AS m, (sum(y * y) OVER (PARTITION BY doc_id) - y * y) / nullif(n, 0) AS q FROM e), g AS (SELECT *, sqrt(greatest(q - m * m, 0)) AS sd FROM f)\n--\nSELECT doc_id, sentence_index, CASE WHEN sd < 1e-9 THEN 0.0 ELSE least(greatest((y - m) / sd, -6), 6) END AS n_words_loo_z FROM g", "n_words_loo_z")
def _(s, d):
    return context.loo_mean_z(sv(s, d).withColumn("n_words", F.col("n_words").cast("double")), "n_words").select("doc_id", "sentence_index", "n_words_loo_z")


SM = f"""{SV}, b AS (SELECT *, CASE WHEN probability IS NULL THEN 0.0 ELSE coalesce(CASE WHEN reliable THEN n_words::DOUBLE ELSE 0.0 END, 0.0) END AS _w FROM sv), b2 AS (SELECT *, coalesce(probability, 0.0) * _w AS _pw FROM b), b3 AS (SELECT *, coalesce(lag(_w) OVER o, 0) + coalesce(lead(_w) OVER o, 0) + 2 * _w AS _sw, coalesce(lag(_pw) OVER o, 0) + coalesce(lead(_pw) OVER o, 0) + 2 * _pw AS _sp FROM b2 WINDOW o AS (PARTITION BY doc_id ORDER BY sentence_index)),
sm AS (SELECT * EXCLUDE (smoothed), CASE WHEN reliable AND _sw > 0 THEN _sp / _sw ELSE probability END AS smoothed FROM b3)"""


@query("w7_smoothing", f"WITH {SM}\n--\nSELECT doc_id, sentence_index, smoothed FROM sm", "smoothed")
def _(s, d):
    return document.smoothed(sv(s, d)).select("doc_id", "sentence_index", "smoothed")


@query("w8_passages", f"WITH {SM}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_index) AS _n FROM sm), i AS (SELECT *, _n - row_number() OVER (PARTITION BY doc_id ORDER BY sentence_index) AS g FROM n WHERE reliable AND smoothed >= 0.65)\n--\nSELECT doc_id, min(sentence_index) AS first_sentence, count(*) AS sentences, arg_min(char_start, _n) AS char_start, arg_max(char_end, _n) AS char_end, sum(n_words)::BIGINT AS n_words, sum(probability * n_words) / nullif(sum(n_words), 0)::DOUBLE AS mean_probability, max(probability) AS peak_probability FROM i GROUP BY doc_id, g", "mean_probability peak_probability")
def _(s, d):
    return document.passages(document.smoothed(sv(s, d)))


@query("a3_document_statistics", f"WITH {DS}\n--\nSELECT doc_id, mean_p, max_p, q90_p, share, log_sentences FROM st", "mean_p max_p q90_p share log_sentences")
def _(s, d):
    return document.statistics(sv(s, d))


@query("a4_verdicts", f"WITH {SV}, x AS (SELECT *, reliable AND probability IS NOT NULL AS ok, coalesce(n_words, 0) AS w FROM sv)\n--\nSELECT doc_id, coalesce(sum(CASE WHEN ok AND probability >= 0.3004 THEN w ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN ok THEN w ELSE 0 END), 0)::DOUBLE, 0.0) AS machine_share, count(*) AS n_sentences, (CASE WHEN sum(CASE WHEN ok THEN 1 ELSE 0 END) > 0 THEN sum(CASE WHEN ok THEN w ELSE 0 END) ELSE sum(w) END)::BIGINT AS n_words, sum(CASE WHEN ok THEN 1 ELSE 0 END)::BIGINT AS n_reliable_sentences FROM x GROUP BY doc_id", "machine_share")
def _(s, d):
    return document.verdicts(sv(s, d))


@query("a5_bootstrap_share")
def _(s, d):
    return document.bootstrap_share(sv(s, d))


_GATE_SQL = _surface_sql("SELECT doc_id AS k1, sentence_index AS k2, text FROM sv WHERE text IS NOT NULL").replace("WITH src", f"WITH {SV}, src")


@query("a6_gate_features", _GATE_SQL.replace("\nSELECT k1", ", o AS (SELECT k1") + ")\n--\nSELECT k1 AS doc_id, " + ", ".join(f"sum(nullif({c}, 0) * coalesce(n_words, 0)) / nullif(sum(CASE WHEN nullif({c}, 0) IS NOT NULL THEN n_words END), 0) AS {c}" for c in ("function_word_rate", "first_person_rate")) + ", sum(coalesce(n_words, 0)) / count(*) AS mean_sentence_words FROM o GROUP BY k1", "function_word_rate first_person_rate mean_sentence_words")
def _(s, d):
    f = r6(features.surface_features(sv(s, d).where("text IS NOT NULL").select("doc_id", "sentence_index", "text")))
    return document.gate_features(f, ("function_word_rate", "first_person_rate"))


@query("flt_p6_reliability", f"WITH {SV}\n--\nSELECT doc_id, sentence_index, CASE WHEN char_start >= 6000 THEN 'beyond_observer_window' WHEN n_words > 90 THEN 'too_long' WHEN n_words < 5 THEN 'too_short' END AS reason FROM sv")
def _(s, d):
    v = sv(s, d)
    return v.select("doc_id", "sentence_index", document.reliability(v, F.lit(6000)).alias("reason"))


@query("flt_p7_bands", f"WITH {DS}\n--\nSELECT doc_id, CASE WHEN role = 'reference' THEN 'out_of_scope' WHEN mean_p IS NULL THEN 'unmeasurable' WHEN mean_p >= 0.8948 THEN 'likely_machine' WHEN mean_p <= 0.0598 THEN 'no_evidence' ELSE 'insufficient' END AS band FROM ds")
def _(s, d):
    x = docs_scored(s, d)
    return x.select("doc_id", document.band(F.col("mean_p"), F.col("mean_p").isNotNull(), ~F.coalesce(F.col("role") == "reference", F.lit(False))).alias("band"))


# An example detector for the scoring queries: weights chosen by hand, not fitted (m2_m5 and m3 fit theirs).
DETECTOR = {"mean_word_len": {"mean": 4.7, "scale": 0.8, "coef": 0.31}, "comma_rate": {"mean": 5.5, "scale": 4.4, "coef": -0.22}, "function_word_rate": {"mean": 46.0, "scale": 9.9, "coef": 0.4}, "first_person_rate": {"mean": 8.0, "scale": 5.0, "coef": -0.35}, "root_ttr": {"mean": 3.9, "scale": 0.6, "coef": 0.27}}
INTERCEPT = -0.1


def scored_surface(s: SparkSession, d: str) -> DataFrame:
    f = r6(features.surface_features(sv(s, d).where("text IS NOT NULL").select("doc_id", "sentence_index", "text")))
    parts = document.contributions(DETECTOR)
    return f.select("doc_id", "sentence_index", "n_words", *(c.alias(n) for n, c in parts.items())).withColumn("logit", F.lit(INTERCEPT) + sum((F.col(n) for n in parts), F.lit(0.0))).withColumn("probability", document.sigmoid(F.col("logit")))


_M4 = _GATE_SQL.replace("\nSELECT k1", ", o AS (SELECT k1") + "), c AS (SELECT k1, k2, n_words, " + ", ".join(f"{p['coef']}::DOUBLE * CASE WHEN {n} IS NULL THEN 0 ELSE least(greatest(({n} - {p['mean']}::DOUBLE) / {p['scale']}::DOUBLE, -5), 5) END AS {n}" for n, p in DETECTOR.items()) + f" FROM o), m4 AS (SELECT *, {INTERCEPT}::DOUBLE + {' + '.join(DETECTOR)} AS logit FROM c)"


@query("m4_contributions", f"{_M4}\n--\nSELECT k1 AS doc_id, k2 AS sentence_index, {', '.join(DETECTOR)}, logit, 1 / (1 + exp(-least(greatest(logit, -30), 30))) AS probability FROM m4", " ".join([*DETECTOR, "logit", "probability"]))
def _(s, d):
    return scored_surface(s, d).drop("n_words")


@query("k1_top_contributions", f"{_M4}, u AS (SELECT k1, k2, logit, unnest([{', '.join(f'{{n: {chr(39)}{n}{chr(39)}, i: {i}, c: {n}}}' for i, n in enumerate(DETECTOR))}]) AS x FROM m4), r AS (SELECT k1, k2, logit, x.n AS name, x.c AS c, row_number() OVER (PARTITION BY k1, k2 ORDER BY abs(x.c) DESC, x.i) AS r FROM u)\n--\nSELECT k1 AS doc_id, k2 AS sentence_index, max(CASE WHEN r = 1 THEN name END) AS first, max(CASE WHEN r = 2 THEN name END) AS second, any_value(logit) - ({INTERCEPT}::DOUBLE) - sum(CASE WHEN r <= 2 THEN c ELSE 0 END) AS remainder FROM r GROUP BY k1, k2", "remainder")
def _(s, d):
    x = scored_surface(s, d)
    x = x.withColumn("top", document.top_contributions({n: F.col(n) for n in DETECTOR}, 2))
    shown = F.aggregate("top", F.lit(0.0), lambda a, c: a + c["contribution"])
    return x.select("doc_id", "sentence_index", F.col("top")[0]["name"].alias("first"), F.col("top")[1]["name"].alias("second"), (F.col("logit") - INTERCEPT - shown).alias("remainder"))


@query("m2_m5_fitted_detector")
def _(s, d):
    x = docs_scored(s, d).where("label IS NOT NULL")
    fitted, intercept = document.fit_detector(x, ["mean_p", "max_p", "q90_p", "share"], c=1.0)
    parts = document.contributions(fitted)
    return x.select("doc_id", document.sigmoid(F.lit(intercept) + sum(parts.values(), F.lit(0.0))).alias("probability"))


@query("m1_standardiser", f"WITH {DS}\n--\nSELECT avg(mean_p) AS mean_mean_p, stddev_pop(mean_p) AS scale_mean_p, avg(share) AS mean_share, stddev_pop(share) AS scale_share FROM ds", "mean_mean_p scale_mean_p mean_share scale_share")
def _(s, d):
    p = document.standardiser(docs_scored(s, d), ["mean_p", "share"])
    return s.createDataFrame([(p["mean_p"]["mean"], p["mean_p"]["scale"], p["share"]["mean"], p["share"]["scale"])], "mean_mean_p double, scale_mean_p double, mean_share double, scale_share double")


# --- metrics and calibration ---------------------------------------------------------------------------------------
CNT = f"{SC}, c AS (SELECT role, probability AS s, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM sc WHERE probability IS NOT NULL AND label IS NOT NULL GROUP BY ALL)"


@query("a11_w11_auroc", f"WITH {CNT}, b AS (SELECT *, sum(neg) OVER (PARTITION BY role ORDER BY s) - neg AS below FROM c)\n--\nSELECT role, sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * sum(neg), 0) AS auroc, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives FROM b GROUP BY role", "auroc")
def _(s, d):
    return metrics.auroc(sc(s, d), "probability", "label", ["role"])


@query("a12_average_precision", f"WITH {CNT}, b AS (SELECT *, sum(pos) OVER o AS tp, sum(pos + neg) OVER o AS k FROM c WINDOW o AS (PARTITION BY role ORDER BY s DESC))\n--\nSELECT role, sum(pos * tp / k::DOUBLE) / nullif(sum(pos), 0)::DOUBLE AS ap, sum(pos * (1 - s) * (1 - s) + neg * s * s) / sum(pos + neg)::DOUBLE AS brier FROM b GROUP BY role", "ap brier")
def _(s, d):
    return metrics.average_precision(sc(s, d), "probability", "label", ["role"])


@query("a13_reliability_table", f"WITH {SC}\n--\nSELECT CASE WHEN probability < 0.1 THEN 0.0 WHEN probability < 0.2 THEN 0.1 WHEN probability < 0.3 THEN 0.2 WHEN probability < 0.4 THEN 0.3 WHEN probability < 0.5 THEN 0.4 WHEN probability < 0.7 THEN 0.5 ELSE 0.7 END::DOUBLE AS band, count(*) AS n, avg(probability) AS mean_p, avg(label) AS observed FROM sc WHERE probability IS NOT NULL AND label IS NOT NULL GROUP BY 1 HAVING count(*) >= 20", "mean_p observed")
def _(s, d):
    p = F.col("probability")
    b = F.when(p < 0.1, 0.0).when(p < 0.2, 0.1).when(p < 0.3, 0.2).when(p < 0.4, 0.3).when(p < 0.5, 0.4).when(p < 0.7, 0.5).otherwise(0.7)
    return sc(s, d).where("probability IS NOT NULL AND label IS NOT NULL").groupBy(b.alias("band")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg("label").alias("observed")).where("n >= 20")


@query("a14_threshold_table", f"WITH {SC}\n--\nSELECT t::DOUBLE AS t, sum((probability >= t AND label = 1)::INT)::BIGINT AS tp, sum((probability >= t AND label = 0)::INT)::BIGINT AS fp FROM sc, (VALUES (0.3), (0.5), (0.65), (0.8), (0.9)) v(t) WHERE probability IS NOT NULL AND label IS NOT NULL GROUP BY t")
def _(s, d):
    x = sc(s, d).where("probability IS NOT NULL AND label IS NOT NULL")
    ts = (0.3, 0.5, 0.65, 0.8, 0.9)
    hit = lambda t, y: F.sum(((F.col("probability") >= t) & (F.col("label") == y)).cast("bigint"))
    one = x.agg(F.array(*(F.struct(F.lit(t).alias("t"), hit(t, 1).alias("tp"), hit(t, 0).alias("fp")) for t in ts)).alias("v"))
    return one.select(F.inline("v"))


@query("a15_w14_choose_threshold", f"WITH {SC}, r AS (SELECT role, round_even(probability, 4) AS s, sum(label) AS pos, sum(1 - label) AS neg FROM sc WHERE probability IS NOT NULL AND label IS NOT NULL GROUP BY ALL), w AS (SELECT role, s AS t, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp FROM r WINDOW o AS (PARTITION BY role ORDER BY s DESC)), p AS (SELECT *, tp / (tp + fp)::DOUBLE AS precision FROM w WHERE t >= 0.3 AND tp + fp >= 10)\n--\nSELECT role, coalesce(min(CASE WHEN precision >= 0.6 THEN t END), arg_max(t, (precision, -t)), 0.3) AS threshold FROM p GROUP BY role", "threshold")
def _(s, d):
    return metrics.choose_threshold(sc(s, d), "probability", "label", ["role"], target=0.6)


@query("a16_tpr_at_fpr", f"WITH {SC}, q AS (SELECT role, quantile_cont(probability, 0.95) AS threshold FROM sc WHERE label = 0 AND probability IS NOT NULL GROUP BY role)\n--\nSELECT q.role, any_value(threshold) AS threshold, avg((probability >= threshold)::INT) AS tpr FROM q JOIN sc ON q.role = sc.role WHERE label = 1 AND probability IS NOT NULL GROUP BY q.role", "threshold tpr")
def _(s, d):
    return metrics.tpr_at_fpr(sc(s, d).where("probability IS NOT NULL"), "probability", "label", ["role"])


@query("a7_a8_a21_flag_rates", f"WITH {SC}, g AS (SELECT source, authorship, grouping(source)::BIGINT AS g_source, grouping(authorship)::BIGINT AS g_authorship, count(*) AS n, sum((probability >= 0.3004)::INT)::BIGINT AS k FROM sc WHERE probability IS NOT NULL GROUP BY GROUPING SETS ((), (source), (authorship), (source, authorship)))\n--\nSELECT *, k / n::DOUBLE AS rate, greatest((k / n::DOUBLE + 1.959963984540054 * 1.959963984540054 / (2 * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n) - 1.959963984540054 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 1.959963984540054 * 1.959963984540054 / (4.0 * n * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n), 0) AS low FROM g", "rate low")
def _(s, d):
    x = sc(s, d).where("probability IS NOT NULL").groupingSets([[], ["source"], ["authorship"], ["source", "authorship"]], "source", "authorship")
    g = x.agg(F.grouping("source").cast("bigint").alias("g_source"), F.grouping("authorship").cast("bigint").alias("g_authorship"), F.count("*").alias("n"), F.sum((F.col("probability") >= 0.3004).cast("bigint")).alias("k"))
    return g.withColumn("rate", F.col("k") / F.col("n")).withColumn("low", metrics.wilson(F.col("k"), F.col("n"))[0])


@query("a22_a24_accusation_rates", f"WITH {DS}\n--\nSELECT role, count(*) AS n, avg((mean_p >= 0.8948)::INT) AS accused, avg((share > 0)::INT) AS highlighted, CASE WHEN stddev_samp(mean_p) * stddev_samp(share) > 1e-12 THEN covar_samp(mean_p, share) / (stddev_samp(mean_p) * stddev_samp(share)) END AS r, CASE WHEN var_samp(mean_p) > 1e-12 THEN covar_samp(mean_p, share) / var_samp(mean_p) END AS slope FROM ds GROUP BY role", "accused highlighted r slope")
def _(s, d):
    x = docs_scored(s, d)
    return x.groupBy("role").agg(F.count("*").alias("n"), F.avg((F.col("mean_p") >= 0.8948).cast("double")).alias("accused"), F.avg((F.col("share") > 0).cast("double")).alias("highlighted"), metrics.correlation("mean_p", "share").alias("r"), F.when(F.var_samp("mean_p") > 1e-12, F.covar_samp("mean_p", "share") / F.var_samp("mean_p")).alias("slope"))


@query("a34_product_table", f"WITH {DS}, b AS (SELECT role, CASE WHEN mean_p >= 0.8948 THEN 'm' WHEN mean_p <= 0.0598 THEN 'h' ELSE 'i' END AS band FROM ds)\n--\nSELECT role, sum((band = 'm')::INT)::BIGINT AS likely_machine, sum((band = 'h')::INT)::BIGINT AS no_evidence, sum((band = 'i')::INT)::BIGINT AS insufficient FROM b GROUP BY role")
def _(s, d):
    b = document.band(F.col("mean_p"), F.lit(True), F.lit(True))
    x = docs_scored(s, d).withColumn("band", b).groupBy("role").pivot("band", ["likely_machine", "no_evidence", "insufficient"])
    return x.count().na.fill(0)


@query("a33_w13_worst_per_role", f"WITH {DS}, r AS (SELECT role, doc_id, max_p, row_number() OVER (PARTITION BY role ORDER BY max_p DESC, doc_id) AS place FROM ds WHERE label = 0)\n--\nSELECT * FROM r WHERE place <= 5", "max_p")
def _(s, d):
    x = docs_scored(s, d).where("label = 0").select("role", "doc_id", "max_p")
    return x.withColumn("place", F.row_number().over(W.partitionBy("role").orderBy(F.desc("max_p"), "doc_id"))).where("place <= 5")


@query("a40_length_leak", f"WITH {SC}, c AS (SELECT n_words AS s, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM sc WHERE n_words IS NOT NULL AND label IS NOT NULL GROUP BY ALL), b AS (SELECT *, sum(neg) OVER (ORDER BY s) - neg AS below FROM c)\n--\nSELECT sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * sum(neg), 0) AS auroc, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives FROM b", "auroc")
def _(s, d):
    return metrics.auroc(sc(s, d), "n_words", "label", [])


@query("a45_repeatability", "SELECT doc_id, sentence_index, max(p) - min(p) AS spread, count(*) AS runs FROM (SELECT *, nullif(probability, 'NaN'::DOUBLE) AS p FROM sentence_verdicts) WHERE p IS NOT NULL GROUP BY ALL HAVING count(*) > 1", "spread")
def _(s, d):
    v = table(s, d, "sentence_verdicts").withColumn("p", F.nullif("probability", F.lit(float("nan")))).where("p IS NOT NULL")
    return v.groupBy("doc_id", "sentence_index").agg((F.max("p") - F.min("p")).alias("spread"), F.count("*").alias("runs")).where("runs > 1")


# --- corpus --------------------------------------------------------------------------------------------------------
@query("a31_s12_composition", f"WITH {ES}, m AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n_words) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS n FROM es WHERE n_words IS NOT NULL)\n--\nSELECT e.source_id, e.essays, e.different, e.words, md.n_words AS middle FROM (SELECT source_id, count(*) AS essays, count(DISTINCT lower(sha256)) AS different, sum(n_words)::BIGINT AS words FROM es GROUP BY source_id) e LEFT JOIN (SELECT source_id, n_words FROM m WHERE i = n // 2) md ON e.source_id IS NOT DISTINCT FROM md.source_id")
def _(s, d):
    e = es(s, d)
    a = e.groupBy("source_id").agg(F.count("*").alias("essays"), F.count_distinct(F.lower("sha256")).alias("different"), F.sum("n_words").cast("bigint").alias("words"))
    m = corpus.rank_element(e, "n_words", ["source_id"], F.floor(F.col("n") / 2), "middle").withColumnRenamed("source_id", "sid")
    return a.join(m, a["source_id"].eqNullSafe(m["sid"]), "left").select("source_id", "essays", "different", "words", "middle")


@query("s23_quartiles", f"WITH {ES}, m AS (SELECT authorship, n_words, row_number() OVER (PARTITION BY authorship ORDER BY n_words) - 1 AS i, count(*) OVER (PARTITION BY authorship) AS n FROM es WHERE n_words IS NOT NULL)\n--\nSELECT authorship, max(CASE WHEN i = 0 THEN n_words END) AS low, max(CASE WHEN i = n // 4 THEN n_words END) AS p25, max(CASE WHEN i = n // 2 THEN n_words END) AS middle, max(CASE WHEN i = 3 * n // 4 THEN n_words END) AS p75, max(CASE WHEN i = n - 1 THEN n_words END) AS high FROM m GROUP BY authorship")
def _(s, d):
    n = F.col("n")
    places = {"low": F.lit(0), "p25": F.floor(n / 4), "middle": F.floor(n / 2), "p75": F.floor(3 * n / 4), "high": n - 1}
    m = corpus.rank_elements(es(s, d).select("authorship", "n_words"), "n_words", ["authorship"], places)
    return m.groupBy("authorship").agg(*(F.max(F.when(F.col("place") == p, F.col("element"))).alias(p) for p in places))


@query("u2_u5_first_by_hash", "SELECT sha, id FROM (SELECT lower(sha256) AS sha, id, row_number() OVER (PARTITION BY lower(sha256) ORDER BY ingested_at, id) AS r FROM essays WHERE sha256 IS NOT NULL) WHERE r = 1")
def _(s, d):
    e = table(s, d, "essays").where("sha256 IS NOT NULL").withColumn("sha", F.lower("sha256"))
    return corpus.first_by(e, ["sha"], ["ingested_at", "id"]).select("sha", "id")


@query("u3_set_difference", "WITH a AS (SELECT DISTINCT id FROM corpus_plan), b AS (SELECT DISTINCT id FROM essays WHERE authorship = 'machine')\n--\nSELECT id, 'left' AS side FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT id, 'right' AS side FROM (SELECT id FROM b EXCEPT SELECT id FROM a)")
def _(s, d):
    return corpus.set_difference(table(s, d, "corpus_plan").select("id").distinct(), table(s, d, "essays").where("authorship = 'machine'").select("id").distinct())


@query("u4_split_disjointness", "SELECT a.role AS a, b.role AS b, count(*) AS shared FROM (SELECT DISTINCT lower(trim(role)) AS role, lower(sha256) AS sha FROM essays) a JOIN (SELECT DISTINCT lower(trim(role)) AS role, lower(sha256) AS sha FROM essays) b ON a.sha = b.sha AND a.role < b.role GROUP BY ALL")
def _(s, d):
    e = table(s, d, "essays").select(F.lower(F.trim("role")).alias("role"), F.lower("sha256").alias("sha")).distinct()
    return e.alias("x").join(e.alias("y"), F.expr("x.sha = y.sha AND x.role < y.role")).groupBy(F.col("x.role").alias("a"), F.col("y.role").alias("b")).agg(F.count("*").alias("shared"))


@query("u1_union_by_name", "SELECT id AS key, source_id AS source, 'essay' AS kind FROM essays UNION ALL SELECT doc_id::VARCHAR, source, 'document' FROM documents")
def _(s, d):
    a = table(s, d, "essays").select(F.col("id").alias("key"), F.col("source_id").alias("source"), F.lit("essay").alias("kind"))
    return a.unionByName(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "source", F.lit("document").alias("kind")))


@query("flt_p16_w12_even_half", f"WITH {ES}\n--\nSELECT id, (row_number() OVER (PARTITION BY source_id ORDER BY id) - 1) % 2 AS half FROM es")
def _(s, d):
    return corpus.even_half(es(s, d), "id", ["source_id"]).select("id", F.col("half").cast("bigint").alias("half"))


@query("k7_s18_budget", "SELECT doc_id, model FROM (SELECT doc_id, model, sum(coalesce(neurons, 0)) OVER (PARTITION BY model ORDER BY observed_at, doc_id, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT doc_id, model, neurons, observed_at, n_tokens AS k FROM observations)) WHERE coalesce(before, 0) < 500")
def _(s, d):
    o = table(s, d, "observations").select("doc_id", "model", "neurons", "observed_at", F.col("n_tokens").alias("k")).distinct().withColumn("cost", F.coalesce("neurons", F.lit(0.0)))
    return corpus.within_budget(o, ["model"], ["observed_at", "doc_id", "k"], "cost", 500.0).select("doc_id", "model")


@query("s16_cache_misses", "SELECT DISTINCT sha256('m' || chr(0) || text) AS key FROM documents WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM essays e WHERE e.text = documents.text)")
def _(s, d):
    key = F.sha2(F.concat(F.lit("m\0"), F.col("text")), 256).alias("key")
    return corpus.cache_misses(table(s, d, "documents").where("text IS NOT NULL").select(key), table(s, d, "essays").select(key))


@query("s19_clipped", "SELECT doc_id, length(text) > 6000 AS clipped, md5(left(text, 6000)) AS head FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", (F.length("text") > 6000).alias("clipped"), F.md5(F.substring("text", 1, 6000)).alias("head"))


@query("s24_j8_bundles", f"WITH {SV}, {ES}\n--\nSELECT s.doc_id, list(sentence_index ORDER BY sentence_index)::VARCHAR AS spans, any_value(e.id) IS NULL AS missing FROM sv s LEFT JOIN es e ON s.doc_id = e.id GROUP BY s.doc_id")
def _(s, d):
    spans = sv(s, d).groupBy("doc_id").agg(F.array_sort(F.collect_list("sentence_index")).alias("l"))
    e = es(s, d).select(F.col("id").alias("doc_id"), F.lit(True).alias("there"))
    return spans.join(e, "doc_id", "left").select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x.cast("string")), ", "), F.lit("]")).alias("spans"), F.col("there").isNull().alias("missing"))


@query("j10_j11_hybrid_bases", f"WITH {ES}\n--\nSELECT id FROM es WHERE authorship = 'human' AND NOT EXISTS (SELECT 1 FROM es h WHERE h.authorship = 'hybrid' AND h.meta->>'base_doc_id' = es.id)")
def _(s, d):
    e = es(s, d)
    bases = e.where("authorship = 'hybrid'").select(F.get_json_object("meta", "$.base_doc_id").alias("id")).where("id IS NOT NULL").distinct()
    return e.where("authorship = 'human'").select("id").join(bases, "id", "left_anti")


@query("j13_j16_plan_against_meta", f"WITH {ES}, p AS (SELECT id, any_value(model ORDER BY model) AS m FROM corpus_plan GROUP BY id), x AS (SELECT id, meta->>'model' AS m FROM es WHERE authorship = 'machine')\n--\nSELECT coalesce(p.id, x.id) AS id, CASE WHEN p.id IS NULL THEN 'right_only' WHEN x.id IS NULL THEN 'left_only' WHEN p.m IS NOT DISTINCT FROM x.m THEN 'equal' ELSE 'different' END AS outcome FROM p FULL JOIN x ON p.id = x.id")
def _(s, d):
    p = table(s, d, "corpus_plan").groupBy("id").agg(F.min("model").alias("m"))
    x = es(s, d).where("authorship = 'machine'").select("id", F.get_json_object("meta", "$.model").alias("m"))
    j = p.select("id", F.col("m").alias("a"), F.lit(True).alias("l")).join(x.select("id", F.col("m").alias("b"), F.lit(True).alias("r")), "id", "full")
    return j.select("id", F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").when(F.col("a").eqNullSafe(F.col("b")), "equal").otherwise("different").alias("outcome"))


@query("s11_j17_registry_attach", f"WITH {ES}\n--\nSELECT id, label, coalesce(lower(trim(es.role)) IS DISTINCT FROM r.role, false) AS role_differs FROM es LEFT JOIN source_registry r USING (source_id)")
def _(s, d):
    r = table(s, d, "source_registry").select("source_id", "label", F.col("role").alias("listed"))
    return corpus.attach(es(s, d), r, ["source_id"]).select("id", "label", (~F.lower(F.trim("role")).eqNullSafe(F.col("listed"))).alias("role_differs"))


@query("j14_j20_observer_alignment", "WITH o AS (SELECT doc_id, model, avg(neurons) AS x FROM (SELECT DISTINCT * FROM observations) WHERE neurons IS NOT NULL GROUP BY ALL)\n--\nSELECT a.model AS a, b.model AS b, count(*) AS n, CASE WHEN stddev_samp(a.x) * stddev_samp(b.x) > 1e-12 THEN covar_samp(a.x, b.x) / (stddev_samp(a.x) * stddev_samp(b.x)) END AS r FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.model < b.model GROUP BY ALL HAVING count(*) >= 3", "r")
def _(s, d):
    o = table(s, d, "observations").distinct().where("neurons IS NOT NULL").groupBy("doc_id", "model").agg(F.avg("neurons").alias("x"))
    return o.alias("p").join(o.alias("q"), F.expr("p.doc_id = q.doc_id AND p.model < q.model")).groupBy(F.col("p.model").alias("a"), F.col("q.model").alias("b")).agg(F.count("*").alias("n"), metrics.correlation("p.x", "q.x").alias("r")).where("n >= 3")


@query("w17_group_folds", f"WITH {ES}, g AS (SELECT source_id, count(*) AS n FROM es GROUP BY source_id), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source_id NULLS FIRST) - 1 AS i FROM g)\n--\nSELECT source_id, n, (CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END)::INT AS fold FROM r")
def _(s, d):
    return corpus.fold_of_groups(es(s, d).groupBy("source_id").agg(F.count("*").alias("n")), "n")


# --- state and streams ---------------------------------------------------------------------------------------------
QUERIES["r1_r3_rate_limit"] = lambda s, d: limiter.rate_limit(table(s, d, "events"))
SQL["r1_r3_rate_limit"] = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT event_id, user_id, n, true AS admitted, [t] AS hits FROM e WHERE n = 1
UNION ALL SELECT event_id, user_id, n, ok, CASE WHEN ok THEN list_append(kept, t) ELSE kept END FROM (SELECT e.*, list_filter(r.hits, lambda h: e.t - h < 3600) AS kept, len(list_filter(r.hits, lambda h: e.t - h < 3600)) < 60 AND len(list_filter(r.hits, lambda h: e.t - h < 60)) < 6 AS ok FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT event_id, user_id, admitted FROM r"""


@query("r2_daily_budget", "WITH e AS (SELECT event_id, date_trunc('day', ts) AS day, ts, coalesce(value, 0.0) AS cost FROM events), x AS (SELECT *, sum(cost) OVER (PARTITION BY day ORDER BY ts, event_id) - cost AS spent_before FROM e)\n--\nSELECT event_id, day::TIMESTAMP AS day, spent_before, spent_before + cost <= 7000 AS admitted FROM x", "spent_before")
def _(s, d):
    return limiter.daily_budget(table(s, d, "events")).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("r_ext_windowed_rates", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY ALL", "mean_value")
def _(s, d):
    w = limiter.windowed_rates(table(s, d, "events"))
    return w.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("r_ext_sessions", "WITH e AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true) AS new FROM events WHERE user_id IS NOT NULL), g AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)\n--\nSELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM g GROUP BY user_id, k")
def _(s, d):
    w = limiter.sessions(table(s, d, "events"))
    return w.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))
