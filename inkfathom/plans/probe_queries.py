"""Probes, controls and audits: full forms of the evaluation inventory. Conventions of :mod:`core_queries`."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from inkfathom.operators import corpus, document, metrics, models, probes, ranks, vocabulary
from inkfathom.plans.core_queries import DS, ES, SC, SV, docs_scored, es, query, sc, sv
from inkfathom.session import checkpoint_dir, table

#: P(X <= k) of n trials at rate b, as SQL: the exact bound of k of n is within b where it is at most 0.05.
CDF = "list_sum(list_transform(range(0, {k}::BIGINT + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({b}) + ({n} - i) * ln(1 - {b}))))"
within = lambda k, n, b: f"({k} < {n} AND {CDF.format(k=k, n=n, b=b)} <= 0.05)"

# --- labels from spans ---------------------------------------------------------------------------------------------
LB = f"""{SV}, {ES}, mspan AS (SELECT doc_id, char_start AS s, char_end AS e FROM sv WHERE reliable AND probability >= 0.8),
lb AS (SELECT sv.doc_id, sv.sentence_index, sv.probability, es.authorship, CASE es.authorship WHEN 'human' THEN 0 WHEN 'machine' THEN 1 WHEN 'hybrid' THEN (EXISTS (SELECT 1 FROM mspan m WHERE m.doc_id = sv.doc_id AND m.s <= (sv.char_start + sv.char_end) // 2 AND (sv.char_start + sv.char_end) // 2 < m.e))::INT END AS label FROM sv JOIN es ON sv.doc_id = es.id)"""


def labelled(s, d):
    """Sentences with labels from machine spans: those of a hybrid's reliable sentences that score at least 0.8."""
    spans = sv(s, d).where("reliable AND probability >= 0.8").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("char_start").alias("s"), F.col("char_end").alias("e"))).alias("spans"))  # a document's sentences
    e = es(s, d).select(F.col("id").alias("doc_id"), "authorship").join(spans, "doc_id", "left")
    middle = F.expr("(char_start + char_end) div 2")
    x = sv(s, d).join(e, "doc_id").withColumn("middle", middle)
    none = F.expr("array_repeat(named_struct('s', 0, 'e', 0), 0)")
    return x.select("doc_id", "sentence_index", "probability", "authorship", corpus.label(F.col("authorship"), F.col("middle"), F.coalesce("spans", none)).alias("label"))


@query("flt_p2_j12_span_labels", f"WITH {LB}\n--\nSELECT doc_id, sentence_index, label FROM lb")
def _(s, d):
    return labelled(s, d).select("doc_id", "sentence_index", "label")


@query("a9_seam_accuracy", f"WITH {LB}, g AS (SELECT doc_id, min(sentence_index) FILTER (label = 1) AS seam, min(sentence_index) FILTER (probability >= 0.5) AS found FROM lb WHERE authorship = 'hybrid' GROUP BY doc_id HAVING sum(label) BETWEEN 1 AND count(*) - 1)\n--\nSELECT count(*) AS documents, count(found) AS with_flag, trunc(median(found - seam))::INT AS median_offset, avg((abs(found - seam) <= 2)::INT) AS within_two FROM g WHERE found IS NOT NULL", "within_two")
def _(s, d):
    first = lambda c: F.min(F.when(c, F.col("sentence_index")))
    g = labelled(s, d).where("authorship = 'hybrid'").groupBy("doc_id").agg(first(F.col("label") == 1).alias("seam"), first(F.col("probability") >= 0.5).alias("found"), F.sum("label").alias("ones"), F.count("*").alias("n"))
    g = g.where("ones BETWEEN 1 AND n - 1 AND found IS NOT NULL").withColumn("off", (F.col("found") - F.col("seam")).cast("double"))
    middle = ranks.quantiles(g, [], "off", [0.5]).select(F.when(F.col("value") < 0, F.ceil("value")).otherwise(F.floor("value")).cast("int").alias("median_offset"))
    a = g.agg(F.count("*").alias("documents"), F.count("found").alias("with_flag"), F.avg((F.abs("off") <= 2).cast("double")).alias("within_two"))
    return a.crossJoin(F.broadcast(middle))  # one row each


# --- bounds and thresholds -----------------------------------------------------------------------------------------
@query("a17_upper_bounds", f"WITH {DS}, g AS (SELECT source, sum((mean_p >= 0.5)::INT)::BIGINT AS k, count(*) AS n FROM ds WHERE label = 0 GROUP BY source)\n--\nSELECT source, k, n, {within('k', 'n', '0.05::DOUBLE')} AS within_5, {within('k', 'n', '0.4::DOUBLE')} AS within_40 FROM g")
def _(s, d):
    g = docs_scored(s, d).where("label = 0").groupBy("source").agg(F.sum((F.col("mean_p") >= 0.5).cast("bigint")).alias("k"), F.count("*").alias("n"))
    u = g.withColumn("u", metrics.cp_upper()("k", "n"))
    return u.select("source", "k", "n", (F.col("u") <= 0.05).alias("within_5"), (F.col("u") <= 0.4).alias("within_40"))


AT_RISK = f"{DS}, hf AS (SELECT *, (row_number() OVER (PARTITION BY role ORDER BY doc_id) - 1) % 2 AS half FROM ds WHERE label IS NOT NULL)"


def even(s, d):
    return corpus.even_half(docs_scored(s, d).where("label IS NOT NULL"), "doc_id", ["role"]).where("half = 0")


@query("a18_bands", f"""WITH {AT_RISK}, x AS (SELECT mean_p AS p, label FROM hf WHERE half = 0), gr AS (SELECT DISTINCT round_even(p, 4) AS cut FROM x UNION SELECT 0.0 UNION SELECT 1.0),
ct AS (SELECT cut, (SELECT count(*) FROM x WHERE label = 0 AND p >= cut) AS fp, (SELECT count(*) FROM x WHERE label = 1 AND p <= cut) AS fn, (SELECT count(*) FROM x WHERE label = 0) AS nh, (SELECT count(*) FROM x WHERE label = 1) AS nm FROM gr),
t0 AS (SELECT coalesce(min(cut) FILTER ({within('fp', 'nh', '0.05::DOUBLE')}), 1.0) AS tm, coalesce(max(cut) FILTER ({within('fn', 'nm', '0.10::DOUBLE')}), 0.0) AS th FROM ct), t AS (SELECT tm, least(th, tm) AS th FROM t0)
--
SELECT any_value(tm) AS t_machine, any_value(th) AS t_human, avg((p >= tm)::INT) FILTER (label = 0) AS observed_fpr, avg((p <= th)::INT) FILTER (label = 1) AS observed_miss, avg((p > th AND p < tm)::INT) FILTER (label = 0) AS abstain_human, avg((p > th AND p < tm)::INT) FILTER (label = 1) AS abstain_machine, count(*) FILTER (label = 0) AS n_human, count(*) FILTER (label = 1) AS n_machine FROM x, t""", "t_machine t_human observed_fpr observed_miss abstain_human abstain_machine")
def _(s, d):
    return metrics.fit_bands(even(s, d), "mean_p", "label")


def _cut_sql(source: str, score: str, budget: float, side: str) -> str:
    op, pick = (">=", "ASC") if side == "above" else ("<", "DESC")
    return f"cx AS (SELECT {score} AS p FROM {source} WHERE {score} IS NOT NULL), cu AS (SELECT cut, (SELECT count(*) FROM cx WHERE p {op} cut) AS k, (SELECT count(*) FROM cx) AS n FROM (SELECT DISTINCT round_even(p, 4) AS cut FROM cx)), best AS (SELECT * FROM cu WHERE {within('k', 'n', f'{budget}::DOUBLE')} ORDER BY cut {pick} LIMIT 1)"


@query("a19_document_cut", f"WITH {AT_RISK}, hr AS (SELECT * FROM hf WHERE half = 0 AND label = 0), {_cut_sql('hr', 'mean_p', 0.05, 'above')}\n--\nSELECT cut, k, n FROM best", "cut")
def _(s, d):
    return metrics.budget_cut(even(s, d).where("label = 0"), "mean_p", 0.05)


# A gate for the scoring queries: weights by hand, on statistics that every document has; probes.gate_fit fits one.
GATE = {"mean_p": {"mean": 0.4, "scale": 0.25, "coef": -0.9}, "share": {"mean": 0.35, "scale": 0.3, "coef": -0.4}, "log_sentences": {"mean": 2.4, "scale": 0.4, "coef": 0.8}}
GATE_SQL = "1 / (1 + exp(-least(greatest(0.5::DOUBLE + " + " + ".join(f"{p['coef']}::DOUBLE * coalesce(least(greatest(({n} - {p['mean']}::DOUBLE) / {p['scale']}::DOUBLE, -5), 5), 0)" for n, p in GATE.items()) + ", -30), 30)))"


def gated(s, d):
    return docs_scored(s, d).withColumn("gate", models.gate_probability(GATE, 0.5))


@query("m6_gate_scores", f"WITH {DS}\n--\nSELECT doc_id, {GATE_SQL} AS gate FROM ds", "gate")
def _(s, d):
    return gated(s, d).select("doc_id", "gate")


@query("a20_gate_threshold", f"WITH {DS}, gt AS (SELECT *, {GATE_SQL} AS gate FROM ds WHERE role = 'train'), {_cut_sql('gt', 'gate', 0.02, 'below')}\n--\nSELECT cut, k, n, abs(avg((gate < cut)::INT) FILTER (label = 0) - avg((gate < cut)::INT) FILTER (label = 1)) > 0.10 AS vetoed FROM best, gt GROUP BY cut, k, n", "cut")
def _(s, d):
    return probes.gate_threshold(gated(s, d).where("role = 'train'"), "gate", "label", 0.02)


@query("a35_p7_gate_selectivity", f"WITH {DS}, g AS (SELECT *, {GATE_SQL} < 0.55 AS refused, mean_p >= 0.8948 AS flagged FROM ds WHERE label IS NOT NULL)\n--\nSELECT sum(refused::INT)::BIGINT AS refusals, sum((refused AND label = 0 AND flagged)::INT)::BIGINT AS saves, sum((refused AND label = 0 AND flagged)::INT) / nullif(sum(refused::INT), 0)::DOUBLE AS refusal_precision, sum(refused::INT) / nullif(sum((refused AND label = 0 AND flagged)::INT), 0)::DOUBLE AS refusals_per_save, sum((NOT refused AND mean_p <= 0.0598)::INT)::BIGINT AS no_evidence, sum((NOT refused AND mean_p >= 0.8948)::INT)::BIGINT AS likely_machine FROM g", "refusal_precision refusals_per_save")
def _(s, d):
    x = gated(s, d).where("label IS NOT NULL")
    x = x.withColumn("refused", F.col("gate") < 0.55).withColumn("band", document.band(F.col("mean_p"), F.col("mean_p").isNotNull(), F.col("gate") >= 0.55))
    n = lambda c: F.sum(c.cast("bigint"))
    save = F.col("refused") & (F.col("label") == 0) & (F.col("mean_p") >= 0.8948)
    g = x.agg(n(F.col("refused")).alias("refusals"), n(save).alias("saves"), n(F.col("band") == "no_evidence").alias("no_evidence"), n(F.col("band") == "likely_machine").alias("likely_machine"))
    return g.withColumn("refusal_precision", F.try_divide(F.col("saves").cast("double"), F.col("refusals"))).withColumn("refusals_per_save", F.try_divide(F.col("refusals").cast("double"), F.col("saves")))


@query("a36_ensemble_at_equal_budget", "\n--\n".join([f"WITH {DS}, u AS (SELECT label, unnest(['first', 'second', 'maximum']) AS arm, unnest([mean_p, share, greatest(mean_p, share)]) AS p FROM ds WHERE label IS NOT NULL), gr AS (SELECT DISTINCT arm, round_even(p, 4) AS cut FROM u WHERE label = 0), ct AS (SELECT arm, cut, (SELECT count(*) FROM u WHERE u.arm = gr.arm AND label = 0 AND p >= cut) AS fp, (SELECT count(*) FROM u WHERE u.arm = gr.arm AND label = 0) AS n FROM gr), b AS (SELECT arm, min(cut) AS cut FROM ct WHERE {within('fp', 'n', '0.05::DOUBLE')} GROUP BY arm)", "SELECT arm, cut, avg((p >= cut)::INT) AS recall FROM b JOIN u USING (arm) WHERE label = 1 GROUP BY arm, cut"]), "cut recall")
def _(s, d):
    return probes.arms_at_budget(docs_scored(s, d).where("label IS NOT NULL").select("label", F.col("mean_p").alias("first"), F.col("share").alias("second"), F.greatest("mean_p", "share").alias("maximum")), ["first", "second", "maximum"], "label", 0.05)


# --- breakdowns ----------------------------------------------------------------------------------------------------
MT = f"{DS}, mt AS (SELECT ds.*, meta->>'model' AS model, meta->>'style' AS style, (meta->>'ell')::BOOLEAN AS ell, TRY_CAST(meta->>'proficiency' AS DOUBLE) AS prof, meta->>'base_doc_id' AS base FROM ds JOIN es ON ds.doc_id = es.id)"


def with_meta(s, d):
    get = lambda k: F.get_json_object("meta", f"$.{k}")
    m = es(s, d).select(F.col("id").alias("doc_id"), get("model").alias("model"), get("style").alias("style"), get("ell").cast("boolean").alias("ell"), get("proficiency").try_cast("double").alias("prof"), get("base_doc_id").alias("base"))
    return docs_scored(s, d).join(m, "doc_id")


@query("a8_breakdown", f"WITH {MT}, u AS (SELECT mean_p, unnest([{{k: 'model', v: model || '/' || coalesce(style, '-')}}, {{k: 'source', v: source}}, {{k: 'ell', v: ell::VARCHAR}}, {{k: 'proficiency', v: (round_even(2 * prof, 0) / 2)::DECIMAL(9, 1)::VARCHAR}}]) AS x FROM mt)\n--\nSELECT x.k AS kind, x.v AS value, count(*) AS n, avg(mean_p) AS mean_p, avg((mean_p >= 0.5)::INT) AS flagged FROM u WHERE x.v IS NOT NULL GROUP BY ALL HAVING x.k <> 'proficiency' OR count(*) >= 30", "mean_p flagged")
def _(s, d):
    band = (F.bround(F.col("prof") * 2, 0) / 2).cast("decimal(9,1)").cast("string")
    kinds = {"model": F.concat(F.col("model"), F.lit("/"), F.coalesce("style", F.lit("-"))), "source": F.col("source"), "ell": F.col("ell").cast("string"), "proficiency": band}
    u = with_meta(s, d).select("mean_p", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()))).alias("x")).select("mean_p", "x.*").where("value IS NOT NULL")
    return u.groupBy("kind", "value").agg(F.count("*").alias("n"), F.avg("mean_p").alias("mean_p"), F.avg((F.col("mean_p") >= 0.5).cast("double")).alias("flagged")).where("kind <> 'proficiency' OR n >= 30")


@query("a10_matched_ablation", f"WITH {MT}\n--\nSELECT count(*) AS pairs, avg(o.mean_p) AS original, avg(r.mean_p) AS rewritten, avg((r.mean_p > o.mean_p)::INT) AS rises, avg(r.mean_p - o.mean_p) AS shift FROM mt r JOIN mt o ON r.base = o.doc_id", "original rewritten rises shift")
def _(s, d):
    x = with_meta(s, d)
    j = x.select(F.col("base").alias("doc_id"), F.col("mean_p").alias("r")).join(x.select("doc_id", F.col("mean_p").alias("o")), "doc_id")
    return j.agg(F.count("*").alias("pairs"), F.avg("o").alias("original"), F.avg("r").alias("rewritten"), F.avg((F.col("r") > F.col("o")).cast("double")).alias("rises"), F.avg(F.col("r") - F.col("o")).alias("shift"))


@query("a37_generator_comparison", f"WITH {MT}, g AS (SELECT source, model, avg(mean_p) AS m FROM mt WHERE model IS NOT NULL AND source IS NOT NULL GROUP BY ALL)\n--\nSELECT a.model AS before, b.model AS after, count(*) AS sources, avg(b.m - a.m) AS shift, avg((b.m > a.m)::INT) AS rising, (avg(b.m - a.m) > 0) = (avg((b.m > a.m)::INT) > 0.5) AS agrees FROM g a JOIN g b ON a.source = b.source AND a.model < b.model GROUP BY ALL", "shift rising")
def _(s, d):
    g = with_meta(s, d).where("model IS NOT NULL AND source IS NOT NULL").groupBy("source", "model").agg(F.avg("mean_p").alias("m"))
    j = g.alias("a").join(g.alias("b"), F.expr("a.source = b.source AND a.model < b.model"))
    up = F.avg((F.col("b.m") > F.col("a.m")).cast("double"))
    shift = F.avg(F.col("b.m") - F.col("a.m"))
    return j.groupBy(F.col("a.model").alias("before"), F.col("b.model").alias("after")).agg(F.count("*").alias("sources"), shift.alias("shift"), up.alias("rising"), ((shift > 0) == (up > 0.5)).alias("agrees"))


@query("a22_accusation_audit", f"WITH {MT}, u AS (SELECT *, unnest([{{k: 'overall', v: 'all'}}, {{k: 'source', v: source}}, {{k: 'proficiency', v: (round_even(2 * prof, 0) / 2)::DECIMAL(9, 1)::VARCHAR}}]) AS x FROM mt WHERE label = 0)\n--\nSELECT x.k AS kind, x.v AS value, count(*) AS n, avg((mean_p >= 0.8948)::INT) AS accused, avg((share > 0)::INT) AS highlighted, CASE WHEN stddev_samp(prof) > 1e-12 AND stddev_samp(CASE WHEN prof IS NOT NULL THEN share END) > 1e-12 THEN covar_samp(prof, share) / (stddev_samp(prof) * stddev_samp(CASE WHEN prof IS NOT NULL THEN share END)) END AS r FROM u WHERE x.v IS NOT NULL GROUP BY ALL", "accused highlighted r")
def _(s, d):
    band = (F.bround(F.col("prof") * 2, 0) / 2).cast("decimal(9,1)").cast("string")
    kinds = {"overall": F.lit("all"), "source": F.col("source"), "proficiency": band}
    u = with_meta(s, d).where("label = 0").select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()))).alias("x")).where("x.value IS NOT NULL")
    return u.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"), F.avg((F.col("mean_p") >= 0.8948).cast("double")).alias("accused"), F.avg((F.col("share") > 0).cast("double")).alias("highlighted"), metrics.correlation("prof", "share").alias("r"))


@query("a23_matched_harm", f"WITH {DS}, t AS (SELECT quantile_cont(mean_p, 0.95) AS threshold FROM ds WHERE role = 'esl-eval' AND label = 0), c AS (SELECT mean_p AS s, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM ds WHERE label IS NOT NULL GROUP BY 1), b AS (SELECT *, sum(neg) OVER (ORDER BY s) - neg AS below FROM c), a AS (SELECT sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS auroc FROM b)\n--\nSELECT any_value(threshold) AS threshold, avg((mean_p >= threshold)::INT) AS recall, any_value(auroc) AS auroc FROM ds, t, a WHERE label = 1", "threshold recall auroc")
def _(s, d):
    x = docs_scored(s, d).where("label IS NOT NULL")
    t = ranks.quantiles(x.where("role = 'esl-eval' AND label = 0"), [], "mean_p", [0.95]).select(F.col("value").alias("threshold"))
    a = metrics.auroc(x, "mean_p", "label", []).select("auroc")
    y = x.where("label = 1").crossJoin(F.broadcast(t)).agg(F.first("threshold").alias("threshold"), F.avg((F.col("mean_p") >= F.col("threshold")).cast("double")).alias("recall"))
    return y.crossJoin(F.broadcast(a))  # one row each


@query("a25_ordinal_correlation", f"WITH {DS}, r AS (SELECT row_number() OVER (ORDER BY mean_p, doc_id) AS a, row_number() OVER (ORDER BY share, doc_id) AS b FROM ds)\n--\nSELECT corr(a, b) AS rho, count(*) AS n FROM r", "rho")
def _(s, d):
    return probes.ordinal_correlation(docs_scored(s, d), "mean_p", "share", "doc_id")


@query("a25_permutation_p")
def _(s, d):
    return probes.permutation_p(docs_scored(s, d), "mean_p", "share", "doc_id", 500)


@query("a26_slopes_and_transplants", "\n--\n".join([f"WITH {MT}, p AS (SELECT * FROM mt WHERE prof IS NOT NULL), u AS (SELECT prof, unnest(['mean_p', 'share', 'log_sentences']) AS feature, unnest([mean_p, share, log_sentences]) AS x FROM p), sl AS (SELECT feature, regr_slope(x, prof) AS slope, corr(x, prof) AS r FROM u GROUP BY feature), mm AS (SELECT avg(mean_p) AS a, avg(share) AS b, avg(log_sentences) AS c FROM ds WHERE role = 'train'), tp AS (SELECT 'mean_p' AS feature, avg((" + GATE_SQL.replace("mean_p -", "a -") + " < 0.55)::INT) AS refused FROM p, mm UNION ALL SELECT 'share', avg((" + GATE_SQL.replace("share -", "b -") + " < 0.55)::INT) FROM p, mm UNION ALL SELECT 'log_sentences', avg((" + GATE_SQL.replace("log_sentences -", "c -") + " < 0.55)::INT) FROM p, mm)", "SELECT feature, slope, r, refused FROM sl JOIN tp USING (feature)"]), "slope r refused")
def _(s, d):
    x = with_meta(s, d)
    return probes.slopes_and_transplants(x.where("prof IS NOT NULL"), x.where("role = 'train'"), list(GATE), "prof", lambda: models.gate_probability(GATE, 0.5), 0.55)


@query("a29_collinearity", f"WITH {DS}, c AS (SELECT corr(mean_p, max_p) AS ab, corr(mean_p, share) AS ac, corr(max_p, share) AS bc FROM ds)\n--\nSELECT 'mean_p' AS feature, (ab * ab + ac * ac - 2 * ab * ac * bc) / (1 - bc * bc) AS r2 FROM c UNION ALL SELECT 'max_p', (ab * ab + bc * bc - 2 * ab * ac * bc) / (1 - ac * ac) FROM c UNION ALL SELECT 'share', (ac * ac + bc * bc - 2 * ab * ac * bc) / (1 - ab * ab) FROM c", "r2")
def _(s, d):
    return probes.collinearity(docs_scored(s, d), ["mean_p", "max_p", "share"])


@query("a30_mcnemar_exact", f"WITH {DS}, g AS (SELECT sum(((mean_p >= 0.5) = (label = 1) AND (max_p >= 0.5) <> (label = 1))::INT)::BIGINT AS b, sum(((mean_p >= 0.5) <> (label = 1) AND (max_p >= 0.5) = (label = 1))::INT)::BIGINT AS c FROM ds WHERE label IS NOT NULL)\n--\nSELECT b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * {CDF.format(k='least(b, c)', n='(b + c)', b='0.5::DOUBLE')}) END AS p_value FROM g", "p_value")
def _(s, d):
    x = docs_scored(s, d).where("label IS NOT NULL")
    right = lambda c: (F.col(c) >= 0.5) == (F.col("label") == 1)
    return probes.mcnemar(x, right("mean_p"), right("max_p"))


@query("a31_corpus_report", f"WITH {ES}, e AS (SELECT *, lower(sha256) AS sha, meta->>'model' AS gen FROM es), f AS (SELECT sha, min(id) AS first FROM e WHERE sha IS NOT NULL GROUP BY sha), u AS (SELECT e.*, (e.sha IS NOT NULL AND e.id <> first)::INT AS dup, unnest([{{k: 'authorship', v: authorship}}, {{k: 'role', v: lower(trim(role))}}, {{k: 'source', v: source_id}}, {{k: 'generator', v: gen}}]) AS x FROM e LEFT JOIN f USING (sha)), m AS (SELECT x.k AS kind, x.v AS value, n_words, row_number() OVER (PARTITION BY x.k, x.v ORDER BY n_words) - 1 AS i, count(*) OVER (PARTITION BY x.k, x.v) AS n FROM u WHERE n_words IS NOT NULL)\n--\nSELECT g.kind, g.value, essays, words, duplicates, unreadable, m.n_words AS middle FROM (SELECT x.k AS kind, x.v AS value, count(*) AS essays, sum(n_words)::BIGINT AS words, sum(dup)::BIGINT AS duplicates, sum((text IS NULL)::INT)::BIGINT AS unreadable FROM u GROUP BY ALL) g LEFT JOIN (SELECT * FROM m WHERE i = n // 2) m ON g.kind = m.kind AND g.value IS NOT DISTINCT FROM m.value")
def _(s, d):
    e = es(s, d).select("id", F.lower("sha256").alias("sha"), "text", "n_words", "authorship", F.lower(F.trim("role")).alias("role"), F.col("source_id").alias("source"), F.get_json_object("meta", "$.model").alias("generator"))
    first = e.where("sha IS NOT NULL").groupBy("sha").agg(F.min("id").alias("first"))
    e = e.join(first, "sha", "left").withColumn("dup", F.coalesce(F.col("id") != F.col("first"), F.lit(False)).cast("bigint"))
    u = e.select("n_words", "dup", F.col("text").isNull().cast("bigint").alias("gone"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("authorship", "role", "source", "generator")))).alias("x")).select("x.*", "n_words", "dup", "gone")
    g = u.groupBy("kind", "value").agg(F.count("*").alias("essays"), F.sum("n_words").cast("bigint").alias("words"), F.sum("dup").alias("duplicates"), F.sum("gone").alias("unreadable"))
    m = corpus.rank_element(u, "n_words", ["kind", "value"], F.floor(F.col("n") / 2), "middle").select(F.col("kind").alias("k"), F.col("value").alias("v"), "middle")
    return g.join(m, g["kind"].eqNullSafe(m["k"]) & g["value"].eqNullSafe(m["v"]), "left").select("kind", "value", "essays", "words", "duplicates", "unreadable", "middle")


@query("a32_p18_ranked_failures", f"WITH {DS}, x AS (SELECT ds.doc_id, abs(mean_p - label) AS error, abs(2 * mean_p - 1) AS confidence, abs(ln(least(greatest(mean_p, 1e-6), 1 - 1e-6) / (1 - least(greatest(mean_p, 1e-6), 1 - 1e-6)))) AS margin, es.n_words AS words FROM ds JOIN es ON ds.doc_id = es.id WHERE label IS NOT NULL AND (mean_p >= 0.5) <> (label = 1))\n--\nSELECT doc_id, error, confidence, error * confidence AS severity, margin, words FROM x ORDER BY round(error * confidence, 9) DESC, round(margin, 9) DESC, words NULLS LAST, doc_id LIMIT 50", "error confidence severity margin")
def _(s, d):
    x = docs_scored(s, d).where("label IS NOT NULL").join(es(s, d).select(F.col("id").alias("doc_id"), F.col("n_words").alias("words")), "doc_id")
    return probes.ranked_failures(x, "mean_p", "label", "words", 50)


@query("a39_consistency_alarm", f"WITH {SV}, u AS (SELECT model, unnest(['probability', 'length', 'n_words']) AS feature, unnest([probability, (char_end - char_start)::DOUBLE, n_words::DOUBLE]) AS x FROM sv WHERE model IS NOT NULL), m AS (SELECT feature, model, median(x) AS md FROM u WHERE x IS NOT NULL GROUP BY ALL), sp AS (SELECT feature, stddev_pop(x) AS spread FROM u WHERE x IS NOT NULL GROUP BY feature)\n--\nSELECT feature, max(md) - min(md) AS gap, any_value(spread) AS spread, (max(md) - min(md)) / nullif(any_value(spread), 0) > 1.0 AS alarm FROM m JOIN sp USING (feature) GROUP BY feature", "gap spread")
def _(s, d):
    v = sv(s, d).where("model IS NOT NULL").select("model", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.expr(e).cast("double").alias("x")) for c, e in (("probability", "probability"), ("length", "char_end - char_start"), ("n_words", "n_words"))))).alias("u")).select("model", "u.*").where("x IS NOT NULL")
    return probes.consistency(v, "feature", "model", "x")


@query("a43_boundary_rates", f"WITH {SC}, m AS (SELECT doc_id, max(probability) AS top FROM sc WHERE label = 0 GROUP BY doc_id), t AS (SELECT quantile_cont(top, 0.95) AS t FROM m), f AS (SELECT doc_id, label, probability >= t AS hit, lag(probability >= t) OVER (PARTITION BY doc_id ORDER BY sentence_index) AS before FROM sc, t)\n--\nSELECT any_value(t) AS threshold, avg(hit::INT) FILTER (label = 0) AS false_boundary_rate, sum((hit AND before)::INT) / nullif(sum(hit::INT), 0)::DOUBLE AS adjacent_rate FROM f, t", "threshold false_boundary_rate adjacent_rate")
def _(s, d):
    return probes.boundary_rates(sc(s, d), "doc_id", "sentence_index", "probability", "label", 0.95)


@query("a44_training_prior", f"WITH {ES}, c AS (SELECT count(*) AS n FROM es WHERE authorship = 'machine' AND lower(trim(role)) = 'train')\n--\nSELECT n, (469 + 19.5::DOUBLE * least(n, 135)) / (3544 + 469 + 19.5::DOUBLE * least(n, 135)) AS prior, (469 + 19.5::DOUBLE * least(n, 135)) / (3544 + 469 + 19.5::DOUBLE * least(n, 135)) > 0.65 AS too_high FROM c", "prior")
def _(s, d):
    n = es(s, d).where("authorship = 'machine' AND lower(trim(role)) = 'train'").agg(F.count("*").alias("n"))
    return n.withColumn("prior", probes.training_prior(F.col("n"))).withColumn("too_high", F.col("prior") > 0.65)


@query("a45_band_stability", "WITH r AS (SELECT doc_id, model AS run, avg(nullif(probability, 'NaN'::DOUBLE)) AS p FROM sentence_verdicts WHERE model IS NOT NULL GROUP BY ALL), b AS (SELECT doc_id, p, CASE WHEN p >= 0.8948 THEN 'm' WHEN p <= 0.0598 THEN 'h' ELSE 'i' END AS band FROM r WHERE p IS NOT NULL)\n--\nSELECT doc_id, count(*) AS runs, max(p) - min(p) AS delta, count(DISTINCT band) = 1 AS stable FROM b GROUP BY doc_id", "delta")
def _(s, d):
    v = table(s, d, "sentence_verdicts").where("model IS NOT NULL").groupBy("doc_id", "model").agg(F.avg(F.nullif("probability", F.lit(float("nan")))).alias("p")).where("p IS NOT NULL")
    b = v.withColumn("band", document.band(F.col("p"), F.lit(True), F.lit(True)))
    return b.groupBy("doc_id").agg(F.count("*").alias("runs"), (F.max("p") - F.min("p")).alias("delta"), (F.count_distinct("band") == 1).alias("stable"))


@query("a46_sign_agreement", "WITH w(name, coef, expected) AS (VALUES ('mean_word_len', 0.31, 1), ('comma_rate', -0.22, 0), ('function_word_rate', 0.4, -1), ('first_person_rate', -0.35, -1), ('root_ttr', 0.27, 1))\n--\nSELECT sum((expected <> 0 AND sign(coef) = expected)::INT)::BIGINT AS agree, sum((expected <> 0 AND sign(coef) <> expected)::INT)::BIGINT AS opposite, sum((expected = 0)::INT)::BIGINT AS no_prior FROM w")
def _(s, d):
    from inkfathom.plans.core_queries import DETECTOR

    rows = s.createDataFrame([(n, p["coef"]) for n, p in DETECTOR.items()], "name string, coef double")
    return probes.sign_agreement(rows, s.createDataFrame([("mean_word_len", 1), ("comma_rate", 0), ("function_word_rate", -1), ("first_person_rate", -1), ("root_ttr", 1)], "name string, expected int"))


@query("j19_grid", f"WITH {DS}, arms(arm) AS (VALUES ('mean_p'), ('max_p'), ('share')), sets AS (SELECT DISTINCT role FROM ds WHERE role IS NOT NULL), u AS (SELECT role, label, unnest(['mean_p', 'max_p', 'share']) AS arm, unnest([mean_p, max_p, share]) AS p FROM ds)\n--\nSELECT s.role, a.arm, count(label) AS n, avg(p) FILTER (label = 1) - avg(p) FILTER (label = 0) AS gap FROM sets s CROSS JOIN arms a LEFT JOIN u ON u.role = s.role AND u.arm = a.arm GROUP BY ALL", "gap")
def _(s, d):
    x = docs_scored(s, d)
    arms = s.createDataFrame([("mean_p",), ("max_p",), ("share",)], "arm string")
    grid = x.where("role IS NOT NULL").select("role").distinct().crossJoin(F.broadcast(arms))  # both sides are names
    u = x.select("role", "label", *(F.col(a) for a in ("mean_p", "max_p", "share"))).unpivot(["role", "label"], ["mean_p", "max_p", "share"], "arm", "p")
    of = lambda y: F.avg(F.when(F.col("label") == y, F.col("p")))
    return grid.join(u, ["role", "arm"], "left").groupBy("role", "arm").agg(F.count("label").alias("n"), (of(1) - of(0)).alias("gap"))


@query("m14_fold_differences", f"WITH {DS}, u AS (SELECT length(doc_id) % 2 + 2 * (ascii(right(doc_id, 1)) % 2) AS fold, label, unnest(['a', 'b']) AS arm, unnest([mean_p, share]) AS s FROM ds WHERE label IS NOT NULL), c AS (SELECT fold, arm, s, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM u GROUP BY ALL), b AS (SELECT *, sum(neg) OVER (PARTITION BY fold, arm ORDER BY s) - neg AS below FROM c), a AS (SELECT fold, arm, sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * sum(neg), 0) AS v FROM b GROUP BY ALL)\n--\nSELECT fold::INT AS fold, max(v) FILTER (arm = 'a') - max(v) FILTER (arm = 'b') AS difference FROM a GROUP BY fold", "difference")
def _(s, d):
    fold = (F.length("doc_id") % 2 + 2 * (F.ascii(F.substring("doc_id", -1, 1)) % 2)).cast("int")
    return probes.fold_differences(docs_scored(s, d).where("label IS NOT NULL").withColumn("fold", fold), "mean_p", "share", "label", "fold")


# --- sampling and plans --------------------------------------------------------------------------------------------
@query("k4_quota_allocation", f"WITH RECURSIVE {ES}, p AS (SELECT meta->>'model' AS model, count(*) AS n FROM es WHERE authorship = 'machine' AND meta->>'model' IS NOT NULL GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n, model) AS i, count(*) OVER () AS k FROM p), a AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS model, 0::BIGINT AS n, 0::BIGINT AS given, 135::BIGINT AS budget UNION ALL SELECT o.i, o.model, o.n, least(a.budget // (o.k - o.i + 1), floor(o.n * 0.65)::BIGINT), a.budget - least(a.budget // (o.k - o.i + 1), floor(o.n * 0.65)::BIGINT) FROM a JOIN o ON o.i = a.i + 1)\n--\nSELECT model, n, given FROM a WHERE i > 0")
def _(s, d):
    pools = es(s, d).where("authorship = 'machine'").groupBy(F.get_json_object("meta", "$.model").alias("model")).agg(F.count("*").alias("n")).where("model IS NOT NULL")
    return probes.quota_allocation(pools, "model", "n", 135, 0.35)


@query("k6_smallest_within_one_error", f"WITH {DS}, u AS (SELECT label, unnest([1, 2, 3, 4]) AS k, unnest([mean_p, mean_p + share, mean_p + share + max_p, mean_p + share + max_p + q90_p]) AS p FROM ds WHERE label IS NOT NULL), t AS (SELECT k, quantile_cont(p, 0.95) AS t FROM u WHERE label = 0 GROUP BY k), h AS (SELECT k, avg((p >= t)::INT) AS hit, count(*) AS n FROM u JOIN t USING (k) WHERE label = 1 GROUP BY k), b AS (SELECT max(hit) AS top, sqrt(greatest(max(hit) * (1 - max(hit)), 1e-9) / greatest(max(n), 1)) AS se FROM h)\n--\nSELECT k, hit, k = (SELECT min(k) FROM h, b WHERE hit >= top - se) AS chosen FROM h", "hit")
def _(s, d):
    sums = ["mean_p", "mean_p + share", "mean_p + share + max_p", "mean_p + share + max_p + q90_p"]
    x = docs_scored(s, d).where("label IS NOT NULL").select("label", F.explode(F.array(*(F.struct(F.lit(i + 1).alias("k"), F.expr(e).alias("p")) for i, e in enumerate(sums)))).alias("u")).select("label", "u.*")
    return probes.smallest_within_one_error(x, "k", "p", "label")


_U = lambda salt, key: f"(('0x' || left(sha256('{salt}:' || {key}), 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("k8_k9_plan", f"WITH s0 AS (SELECT source_id, row_number() OVER (ORDER BY sha256('subject:' || source_id), source_id) - 1 AS place, count(*) OVER () AS n FROM source_registry), s1 AS (SELECT *, row_number() OVER (ORDER BY source_id) - 1 AS si FROM s0), r AS (SELECT source_id, place < round_even(0.6::DOUBLE * n, 0) AS train, si * 5 + f AS idx, f FROM s1, (SELECT unnest(range(5)) AS f)), m AS (SELECT *, idx % 7 AS prompt, idx % 4 AS model, {_U('u', 'idx')} AS u, {_U('v', 'idx')} AS v FROM r), w AS (SELECT *, CASE WHEN u < 0.14 THEN 420 + floor(v * 126) WHEN u < 0.36 THEN 546 + floor(v * 67) WHEN u < 0.52 THEN 613 + floor(v * 37) WHEN u < 0.64 THEN 650 WHEN u < 0.9 THEN 651 + floor(v * 100) ELSE 751 + floor(v * 130) END AS want FROM m)\n--\nSELECT idx::BIGINT AS idx, source_id AS subject, f::INT AS frame, CASE WHEN train THEN 'train' ELSE 'heldout' END AS split, prompt::INT AS prompt, model::INT AS model, greatest(400, round_even(want / 1.068::DOUBLE, 0))::INT AS target_words, ((row_number() OVER (PARTITION BY model ORDER BY sha256('order:' || idx), idx) - 1) // 25)::INT AS batch FROM w")
def _(s, d):
    return probes.generation_plan(table(s, d, "source_registry").select("source_id"), "source_id")


@query("s18_r5_budgeted_run", "WITH o AS (SELECT DISTINCT doc_id, model, n_tokens, neurons, observed_at FROM observations), e AS (SELECT model, doc_id, n_tokens AS k, observed_at, n_tokens * 0.006::DOUBLE AS est, coalesce(neurons, 0) AS cost FROM o), r AS (SELECT *, sum(est) OVER (PARTITION BY model) AS planned, coalesce(sum(cost) OVER (PARTITION BY model ORDER BY observed_at, doc_id, k, cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM e)\n--\nSELECT model, count(*) AS calls, sum((planned > 900)::INT)::BIGINT AS refused, sum((planned <= 900 AND spent < 400)::INT)::BIGINT AS done, sum((planned <= 900 AND spent >= 400)::INT)::BIGINT AS stopped FROM r GROUP BY model")
def _(s, d):
    o = table(s, d, "observations").select("doc_id", "model", "n_tokens", "neurons", "observed_at").distinct().select("model", "doc_id", F.col("n_tokens").alias("k"), "observed_at", (F.col("n_tokens") * 0.006).alias("est"), F.coalesce("neurons", F.lit(0.0)).alias("cost"))
    r = probes.budgeted_run(o, "model", ["observed_at", "doc_id", "k", "cost"], "est", "cost", 900.0, 400.0)
    n = lambda v: F.sum((F.col("outcome") == v).cast("bigint")).alias(v)
    return r.groupBy("model").agg(F.count("*").alias("calls"), n("refused"), n("done"), n("stopped"))


# --- models --------------------------------------------------------------------------------------------------------
FEATURES = ["mean_p", "max_p", "q90_p", "share"]


@query("m3_platt_calibrated")
def _(s, d):
    x = document.out_of_fold(docs_scored(s, d).where("label IS NOT NULL"), FEATURES, "source")
    knots = models.platt_knots(x, "probability", "label", "source")
    return x.select("doc_id", "fold", "probability", models.interpolate(F.col("probability"), knots).alias("calibrated"))


@query("m8_training_run")
def _(s, d):
    return models.train_all(docs_scored(s, d).where("label IS NOT NULL"), FEATURES, "label", "source", os.path.join(checkpoint_dir(s), "artifact-m8"))


_KNOTS = models.knots_of(5.2, -2.3)


@query("n12_knots", f"WITH {SV}, k AS (SELECT list_transform(range(0, 201), lambda i: 1 / (1 + exp(-(5.2::DOUBLE * i / 200 - 2.3::DOUBLE)))) AS y), x AS (SELECT doc_id, sentence_index, least(greatest(probability, 0), 1) * 200 AS g, y FROM sv, k WHERE probability IS NOT NULL)\n--\nSELECT doc_id, sentence_index, y[floor(g)::INT + 1] + (y[least(floor(g)::INT + 2, 201)] - y[floor(g)::INT + 1]) * (g - floor(g)) AS calibrated FROM x", "calibrated")
def _(s, d):
    return sv(s, d).where("probability IS NOT NULL").select("doc_id", "sentence_index", models.interpolate(F.col("probability"), _KNOTS).alias("calibrated"))


@query("m6_fitted_gate")
def _(s, d):
    x = docs_scored(s, d).where("role IS NOT NULL").withColumn("inside", (F.col("role") == "train").cast("int"))
    fitted, intercept = models.fit_gate(x, ["mean_p", "share", "log_sentences"], "inside")
    return x.select("doc_id", models.gate_probability(fitted, intercept).alias("gate"))


@query("m9_leave_one_generator_out")
def _(s, d):
    x = with_meta(s, d).where("label IS NOT NULL")
    return models.leave_one_out(x, FEATURES, "label", F.when(F.col("label") == 1, F.col("model")))


@query("m10_controls")
def _(s, d):
    return models.control_battery(docs_scored(s, d).where("label IS NOT NULL"), FEATURES, "label", "log_sentences")


@query("m11_polish_head")
def _(s, d):
    x = labelled(s, d).where("label IS NOT NULL").join(sv(s, d).select("doc_id", "sentence_index", "n_words", "smoothed"), ["doc_id", "sentence_index"])
    return models.polish_head(x, ["n_words", "smoothed", "probability"], "label", "doc_id", "sentence_index")


@query("m12_arm")
def _(s, d):
    return models.arm(docs_scored(s, d).where("label IS NOT NULL"), FEATURES, "label", "doc_id")


@query("m13_length_ablation")
def _(s, d):
    return models.length_ablation(docs_scored(s, d).where("label IS NOT NULL"), FEATURES, "log_sentences", "label", "source")


@query("t9_word_tfidf", vocabulary.sql("SELECT item_id AS k, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}]+') AS w FROM heldout_items", (1, 2, 3), 3, 40000, "item_id"), "weight norm")
def _(s, d):
    t = vocabulary.tfidf(vocabulary.word_grams(table(s, d, "heldout_items"), "item_id", "text", (1, 2, 3)), "item_id", 3, 40000)
    return t.groupBy("item_id").agg(F.count("*").alias("terms"), F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("weight")).alias("norm"))


@query("t9_character_tfidf", vocabulary.character_sql("SELECT item_id AS k, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}]+') AS w FROM heldout_items", (2, 3, 4), 3, 60000, "item_id"), "weight norm")
def _(s, d):
    t = vocabulary.tfidf(vocabulary.character_grams(table(s, d, "heldout_items"), "item_id", "text", (2, 3, 4)), "item_id", 3, 60000)
    return t.groupBy("item_id").agg(F.count("*").alias("terms"), F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("weight")).alias("norm"))
