"""Predicates, merges, scalar families, sources and budgets in full. Conventions of :mod:`core_queries`."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from inkfathom.functions import lexicons as L
from inkfathom.functions import text as X
from inkfathom.operators import corpus, features, models, ngram
from inkfathom.operators.ranks import row_numbers
from inkfathom.plans.core_queries import ES, LP, SV, _surface_sql, es, model, query, r6, sv
from inkfathom.plans.text_queries import FLAGSHIP_SQL, flagship
from inkfathom.session import checkpoint_dir, table
from inkfathom.sources import files, paged
from inkfathom.streaming import limiter

# The patterns of a text that is no usable essay: a preamble or refusal, markdown, a trailing note.
PREAMBLE = r"(?i)^\s*(here(?:'s| is)\b|sure[,!]|certainly[,!]|of course[,!]|i'?ll write|i'?ll compose|below is\b|i cannot\b|i can'?t\b|i'?m unable\b|as an ai\b|i apologi[sz]e\b)"
MARKDOWN = r"(?m)(^\s{0,3}#{1,6}\s)|(^\s{0,3}[-*+]\s)|(\*\*.+?\*\*)|(^\s{0,3}\d+\.\s)"
TRAILER = r"(?i)(\(?\s*(word count|approx\.?|~)\s*[:\-]?\s*\d{3,4}\s*(words)?\s*\)?|\[.*?\]|note\s*:\s|let me know if)"
_Q = lambda p: p.replace("'", "''")


@query("flt_p5_usable_essay_chain", f"""WITH {ES}, pl AS (SELECT id, min(target_words) AS target FROM corpus_plan GROUP BY id), t AS (SELECT es.id, text AS t, target, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, regexp_replace(text, '\\s+$', '') AS e, trim(string_split(text, chr(10))[1], E' \\t\\r') AS first, len(string_split(text, chr(10))) AS lines FROM es JOIN pl ON es.id = pl.id WHERE text IS NOT NULL)
--
SELECT id, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '{_Q(PREAMBLE)}') THEN 'preamble' WHEN regexp_matches(t, '{_Q(MARKDOWN)}') THEN 'markdown' WHEN regexp_matches(t, '{_Q(TRAILER)}') THEN 'trailing note' WHEN words < 400 THEN 'too short' WHEN abs((words - target) / target::DOUBLE) > 0.25 THEN 'drift' WHEN right(e, 1) NOT IN ('.', '!', '?', '"', '''') THEN 'ends mid-sentence' WHEN len(list_filter(regexp_split_to_array(first, '\\s+'), lambda w: w <> '')) <= 9 AND right(first, 1) NOT IN ('.', '!', '?', '"', '''', ',') AND lines > 1 THEN 'title' END AS reason FROM t""")
def _(s, d):
    plan = table(s, d, "corpus_plan").groupBy("id").agg(F.min("target_words").alias("target"))
    return corpus.usable(es(s, d).where("text IS NOT NULL").select("id", "text").join(plan, "id"), "text", "target", PREAMBLE, MARKDOWN, TRAILER).select("id", "reason")


@query("flt_p10_clean_prompt", f"WITH {ES}, t AS (SELECT id, trim(regexp_replace(meta->>'topic', '(?i)^(prompt|topic|question|essay)\\s*:\\s*', '')) AS t FROM es WHERE meta->>'topic' IS NOT NULL)\n--\nSELECT id, CASE WHEN regexp_matches(t, '(?i)^(write|describe|explain|discuss|tell)\\b') THEN t ELSE 'Write about ' || t END AS prompt FROM t")
def _(s, d):
    return es(s, d).select("id", F.get_json_object("meta", "$.topic").alias("t")).where("t IS NOT NULL").select("id", corpus.cleaned_prompt(F.col("t")).alias("prompt"))


_ONE, _MANY = "‘’‚‛“”„‟‐‑‒–—―−•·´`′", {"…": "...", "«": '"', "»": '"', "″": '"', " ": " ", "½": "1/2", "™": "(TM)"}
_TO = "''''\"\"\"\"-------**''" + "'"


@query("flt_p12_ascii_fold", "SELECT doc_id, md5(" + "".join("replace(" for _ in _MANY) + f"translate(text, '{_ONE}', '{_Q(_TO)}')" + "".join(f", '{a}', '{_Q(b)}')" for a, b in _MANY.items()) + ") AS folded FROM documents WHERE text IS NOT NULL")
def _(s, d):
    t = F.translate("text", _ONE, _TO)
    for a, b in _MANY.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(t).alias("folded"))


@query("flt_p13_first_300_words", "SELECT id, md5(array_to_string(w[1:300], ' ')) AS head FROM (SELECT DISTINCT id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM essays WHERE text IS NOT NULL) WHERE len(w) >= 300")
def _(s, d):
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return table(s, d, "essays").where("text IS NOT NULL").select("id", w.alias("w")).distinct().where("size(w) >= 300").select("id", F.md5(F.array_join(F.slice("w", 1, 300), " ")).alias("head"))


_FUNCTION = "|".join(sorted(L.FUNCTION_WORDS))


@query("flt_p14_masked_in_place", "WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(\\p{L}+)', '\x01\\1\x01', 'g'), '\x01') AS p FROM documents WHERE text IS NOT NULL)\n--\nSELECT doc_id, md5(array_to_string(list_transform(p, lambda x: CASE WHEN regexp_matches(x, '^\\p{L}+$') AND lower(x) NOT IN (" + ", ".join(f"'{w}'" for w in L.FUNCTION_WORDS) + ") THEN '#' ELSE x END), '')) AS masked FROM p")
def _(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(corpus.masked(F.col("text"), L.FUNCTION_WORDS)).alias("masked"))


@query("flt_p21_limitations_panel", "WITH served(role, note) AS (VALUES ('train', 'fitted on'), ('esl-eval', 'second-language writers'))\n--\nSELECT r.source_id, coalesce(s.note || ' (' || r.licence || ')', s.note, 'no figures for ' || coalesce(r.role, 'this set')) AS note, CASE WHEN s.note IS NULL THEN 'fallback' ELSE 'served' END AS tag FROM source_registry r LEFT JOIN served s ON r.role = s.role")
def _(s, d):
    served = s.createDataFrame([("train", "fitted on"), ("esl-eval", "second-language writers")], "role string, note string")
    return corpus.limitations(table(s, d, "source_registry").select("source_id", "role", "licence"), served, "role")


@query("flt_p17_new_columns_only", "SELECT doc_id, length(text) AS letters FROM documents")
def _(s, d):
    t = table(s, d, "documents").select("doc_id", "text")
    return corpus.add_new_columns(t, {"letters": F.length("text")}).select("doc_id", "letters")


# --- merges --------------------------------------------------------------------------------------------------------
_J6 = _surface_sql("SELECT doc_id AS k1, sentence_index AS k2, text FROM sv WHERE text IS NOT NULL").replace("WITH src", "src", 1).replace("\nSELECT k1", ", tf AS (SELECT k1", 1) + ")"


@query("j6_family_merge", f"WITH {SV}, {LP.replace('(SELECT DISTINCT doc_id, sentence_index, text FROM sentence_verdicts)', '(SELECT doc_id, sentence_index, text FROM sv WHERE text IS NOT NULL)')}, cf AS (SELECT k1, k2, CASE WHEN count(*) >= 4 THEN avg(-logprob) END AS m FROM lp GROUP BY k1, k2), {_J6}\n--\nSELECT tf.k1 AS doc_id, tf.k2 AS sentence_index, n_words, comma_rate, m AS corpus_surprisal_mean FROM tf LEFT JOIN cf ON tf.k1 = cf.k1 AND tf.k2 = cf.k2", "corpus_surprisal_mean")
def _(s, d):
    v = sv(s, d).where("text IS NOT NULL").select(F.col("doc_id").alias("k1"), F.col("sentence_index").alias("k2"), "text")
    text = r6(features.surface_features(v)).select("k1", "k2", "n_words", "comma_rate")
    x = text.join(ngram.corpus_features(v, ["k1", "k2"], model(s, d)), ["k1", "k2"], "left")
    return x.select(F.col("k1").alias("doc_id"), F.col("k2").alias("sentence_index"), "n_words", "comma_rate", "corpus_surprisal_mean")


@query("j13_validated_merge", f"WITH {SV}, l AS (SELECT doc_id, sentence_index AS i, char_start AS a, char_end AS b, probability AS lp, n_words + 1 AS xp, probability / (n_words + 1) AS ratio FROM sv WHERE probability IS NOT NULL AND n_words IS NOT NULL AND sentence_index % 11 <> 5), r AS (SELECT doc_id, sentence_index AS i, char_start AS a, char_end + (sentence_index % 13 = 7)::INT AS b, CASE WHEN sentence_index % 7 = 3 THEN probability / (n_words + 1) * 1.01 ELSE probability / (n_words + 1) END AS ratio FROM sv WHERE probability IS NOT NULL AND n_words IS NOT NULL AND sentence_index % 9 <> 4)\n--\nSELECT coalesce(l.doc_id, r.doc_id) AS doc_id, CASE WHEN sum((l.doc_id IS NULL OR r.doc_id IS NULL)::INT) > 0 THEN 'index set' WHEN sum((l.a <> r.a OR l.b <> r.b)::INT) > 0 THEN 'span' WHEN sum((abs(r.ratio - l.lp / l.xp) > 1e-4 * greatest(1, abs(l.lp / l.xp)))::INT) > 0 THEN 'ratio' ELSE 'merged' END AS outcome FROM l FULL JOIN r ON l.doc_id = r.doc_id AND l.i = r.i GROUP BY 1")
def _(s, d):
    v = sv(s, d).where("probability IS NOT NULL AND n_words IS NOT NULL").withColumn("xp", F.col("n_words") + 1).withColumn("ratio", F.col("probability") / F.col("xp"))
    left = v.where("sentence_index % 11 <> 5").select("doc_id", F.col("sentence_index").alias("i"), F.col("char_start").alias("a"), F.col("char_end").alias("b"), (F.col("probability") / F.col("xp")).alias("expected"))
    right = v.where("sentence_index % 9 <> 4").select("doc_id", F.col("sentence_index").alias("i"), F.col("char_start").alias("a"), (F.col("char_end") + (F.col("sentence_index") % 13 == 7).cast("int")).alias("b"), F.when(F.col("sentence_index") % 7 == 3, F.col("ratio") * 1.01).otherwise(F.col("ratio")).alias("ratio"))
    return corpus.validated_merge(left, right)


@query("j15_keep_explanations", f"WITH {ES}, new AS (SELECT source_id, 'essays: ' || count(*) AS note FROM es WHERE source_id IS NOT NULL GROUP BY source_id), old AS (SELECT source_id, licence AS note FROM source_registry)\n--\nSELECT new.source_id, coalesce(nullif(old.note, ''), new.note) AS note, nullif(old.note, '') IS NOT NULL AS kept FROM new LEFT JOIN old USING (source_id)")
def _(s, d):
    new = es(s, d).where("source_id IS NOT NULL").groupBy("source_id").agg(F.concat(F.lit("essays: "), F.count("*").cast("string")).alias("note"))
    return corpus.keep_old(new, table(s, d, "source_registry").select("source_id", F.col("licence").alias("note")), "source_id", "note")


# --- scalar families -----------------------------------------------------------------------------------------------
@query("n2_strings", "SELECT p_partkey, lower(p_name) AS low, trim('  ' || p_name || ' ') AS bare, rtrim(p_name || '..', '.') AS undotted, starts_with(p_name, 'p') AS starts, contains(p_name, '1') AS has, strpos(p_name, ' ')::INT AS place, substring(p_name, 2, 3) AS part, left(p_name, 4) AS head FROM part")
def _(s, d):
    n = F.col("p_name")
    return table(s, d, "part").select("p_partkey", F.lower(n).alias("low"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("bare"), F.regexp_replace(F.concat(n, F.lit("..")), r"\.+$", "").alias("undotted"), n.startswith("p").alias("starts"), n.contains("1").alias("has"), F.locate(" ", n).alias("place"), F.substring(n, 2, 3).alias("part"), F.substring(n, 1, 4).alias("head"))


@query("n14_array_operations", "WITH v AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: round(x::DOUBLE, 3)) AS v FROM embeddings)\n--\nSELECT vec_id, array_to_string(list_append(v, 9.5::DOUBLE), ',') = array_to_string(list_concat(v, [9.5::DOUBLE]), ',') AS appended, v[3:5][1] AS sliced, list_sum(list_concat(v[1:2], v[4:8])) AS without_third, len(list_distinct(v))::INT AS different, list_sort(v)[1] AS least, list_position(v, list_min(v))::INT - 1 AS argmin, list_sum(v[1:4]) AS cumulative_4, list_sum(list_transform(list_zip(v, v[2:8]), lambda p: coalesce(p[1] * p[2], 0))) AS zipped, len(list_filter(v, lambda x: x < 0.1))::INT AS searched FROM v", "sliced without_third least cumulative_4 zipped")
def _(s, d):
    v = table(s, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: F.round(x.cast("double"), 3)).alias("v"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    drop3 = F.filter("v", lambda x, i: i != 2)
    running = F.aggregate("v", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)))))
    zipped = total(F.zip_with("v", F.slice("v", 2, 7), lambda a, b: F.coalesce(a * b, F.lit(0.0))))
    return v.select("vec_id", (F.size(F.array_append("v", F.lit(9.5))) == 9).alias("appended"), F.slice("v", 3, 3)[0].alias("sliced"), total(drop3).alias("without_third"), F.size(F.array_distinct("v")).alias("different"), F.array_sort("v")[0].alias("least"), (F.array_position("v", F.array_min("v")) - 1).cast("int").alias("argmin"), F.element_at(running, 4).alias("cumulative_4"), zipped.alias("zipped"), F.size(F.filter(F.array_sort("v"), lambda x: x < 0.1)).alias("searched"))


@query("n16_maps", f"WITH {ES}\n--\nSELECT id, coalesce(meta->>'model', 'none') AS model, CASE WHEN meta->>'style' IS NOT NULL THEN meta->>'style' ELSE 'plain' END AS merged, (meta->>'lang') AS dug, len(json_keys(meta))::INT AS n_keys FROM es WHERE meta IS NOT NULL")
def _(s, d):
    m = F.from_json("meta", "map<string,string>")
    base = F.create_map(F.lit("style"), F.lit("plain"), F.lit("model"), F.lit("none"))
    known = F.map_filter(m, lambda k, v: v.isNotNull())
    # Later maps win: keys of the first that the second has are dropped before they are joined.
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(known, k), F.lit(False))), known)
    return es(s, d).where("meta IS NOT NULL").select("id", F.coalesce(F.try_element_at(m, F.lit("model")), F.lit("none")).alias("model"), F.try_element_at(merged, F.lit("style")).alias("merged"), F.get_json_object("meta", "$.lang").alias("dug"), F.size(m).alias("n_keys"))


@query("n17_payloads", f"WITH {SV}\n--\nSELECT doc_id, sentence_index, to_json({{docId: doc_id, sentenceIndex: sentence_index, nWords: n_words, reliable: reliable}}) AS payload FROM sv")
def _(s, d):
    fields = [F.col("doc_id").alias("docId"), F.col("sentence_index").alias("sentenceIndex"), F.col("n_words").alias("nWords"), "reliable"]
    payload = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    back = F.from_json(payload, "docId string, sentenceIndex int, nWords int, reliable boolean")
    return sv(s, d).where(back["sentenceIndex"].eqNullSafe(F.col("sentence_index"))).select("doc_id", "sentence_index", payload.alias("payload"))


# --- sources and sinks ---------------------------------------------------------------------------------------------
def _folder(s, d, name: str) -> str:
    return os.path.join(checkpoint_dir(s), f"{name}-{os.path.basename(d.rstrip('/'))}")


@query("s1_s2_json_lines", f"WITH {ES}\n--\nSELECT id, md5(text) AS digest, n_words::BIGINT AS n_words, md5(meta) AS meta FROM es WHERE text IS NOT NULL")
def _(s, d):
    path = _folder(s, d, "lines")
    files.write_jsonl(es(s, d).where("text IS NOT NULL").select("id", "source_id", "text", "authorship", "role", F.col("n_words").cast("bigint").alias("n_words"), "sha256", "meta"), path)
    return files.read_jsonl(s, path).select("id", F.md5("text").alias("digest"), "n_words", F.md5("meta").alias("meta"))


_ITEM_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"


@query("s5_s27_text_files", f"SELECT item_id, md5(text) AS digest FROM heldout_items WHERE {_ITEM_WORDS} >= 50")
def _(s, d):
    path = _folder(s, d, "texts")
    table(s, d, "heldout_items").select("item_id", "text").write.mode("overwrite").partitionBy("item_id").text(path)
    t = files.read_text_files(s, f"{path}/*", 50)
    return t.select(F.regexp_extract("file", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), F.md5(F.regexp_replace("text", r"\n\z", "")).alias("digest"))


@query("s6_html_archive", f"SELECT item_id::VARCHAR AS title, lang AS place, md5(text) AS digest FROM heldout_items WHERE {_ITEM_WORDS} BETWEEN 50 AND 1500")
def _(s, d):
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<html><p>front</p><h3>"), F.col("item_id").cast("string"), F.lit("</h3><h5>"), safe("lang"), F.lit("</h5><p>"), safe("text"), F.lit("</p><h5>later</h5></html>"))
    return files.html_sections(table(s, d, "heldout_items").select(page.alias("html")), least=50, place="h5").select("title", "place", F.md5("text").alias("digest"))


@query("s8_csv_documents", f"SELECT md5(text) AS digest, CASE WHEN item_id % 3 > 0 THEN item_id / 10.0::DOUBLE END AS proficiency FROM heldout_items WHERE {_ITEM_WORDS} >= 50", "proficiency")
def _(s, d):
    path = _folder(s, d, "csv")
    score = F.when(F.col("item_id") % 3 == 0, "n/a").otherwise((F.col("item_id") / 10).cast("string"))
    table(s, d, "heldout_items").select("text", score.alias("score")).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_csv_documents(s, path, "text", "score", 50).select(F.md5("text").alias("digest"), "proficiency")


@query("s22_chat_rows", "SELECT to_json({messages: [{role: 'system', content: 'be brief'}, {role: 'user', content: s_name}, {role: 'assistant', content: s_suppkey::VARCHAR}]})::VARCHAR AS value FROM supplier")
def _(s, d):
    path = _folder(s, d, "chat")
    t = table(s, d, "supplier").select(F.lit("be brief").alias("s"), F.col("s_name").alias("u"), F.col("s_suppkey").cast("string").alias("a"))
    files.write_chat(files.chat_rows(t, "s", "u", "a"), path)
    return s.read.text(path)


@query("s9_s10_paged_rows", "SELECT min(doc_id) AS doc_id, sha256(text) AS sha256, arg_min(lang, doc_id) AS lang FROM documents WHERE text IS NOT NULL AND lang IN ('en', 'es') AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 100 GROUP BY sha256(text)")
def _(s, d):
    n = table(s, d, "documents").count()
    path = f"{d}/documents.parquet"
    options = {"fetch": "inkfathom.sources.paged:parquet_page", "path": path, "pages": str(-(-n // 5000)), "page_size": "5000", "columns": "doc_id,lang,text"}
    return paged.flagged_rows(s, options, "doc_id bigint, lang string, text string", "text", "lang", ("en", "es")).select("doc_id", "sha256", "lang")


@query("s12_manifest", f"WITH {ES}, m AS (SELECT source_id, n_words, row_number() OVER (PARTITION BY source_id ORDER BY n_words) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS n FROM es WHERE n_words IS NOT NULL AND source_id IS NOT NULL), h AS (SELECT DISTINCT source_id, lower(sha256) AS sha256 FROM es WHERE source_id IS NOT NULL AND sha256 IS NOT NULL)\n--\nSELECT r.source_id, 'hash' AS kind, h.sha256 AS value FROM source_registry r JOIN h USING (source_id) UNION ALL SELECT r.source_id, 'middle', m.n_words::VARCHAR FROM source_registry r JOIN m ON r.source_id = m.source_id AND i = n // 2 UNION ALL SELECT source_id, 'dead', NULL FROM source_registry r WHERE NOT EXISTS (SELECT 1 FROM es WHERE es.source_id = r.source_id)")
def _(s, d):
    return corpus.manifest(es(s, d), table(s, d, "source_registry").select("source_id"))


@query("s13_external_sample", "WITH t AS (SELECT doc_id, source, sha256(text) AS sha, doc_id // 100 AS page FROM documents WHERE text IS NOT NULL AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 120), o AS (SELECT source, sha, min(doc_id) AS doc_id FROM t WHERE page % 3 = 0 GROUP BY ALL), f AS (SELECT sha, min(doc_id) AS doc_id FROM o GROUP BY sha), r AS (SELECT o.source, o.sha, o.doc_id, row_number() OVER (PARTITION BY o.source ORDER BY o.doc_id) AS r FROM o JOIN f USING (sha, doc_id))\n--\nSELECT source || ':' || left(sha, 12) AS id, doc_id FROM r WHERE r <= 25")
def _(s, d):
    t = table(s, d, "documents").where("text IS NOT NULL").where(X.count_words(F.col("text")) >= 120).where(F.floor(F.col("doc_id") / 100) % 3 == 0)
    first = t.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min(F.struct("doc_id", "source")).alias("r")).select("sha", "r.*")
    n = row_numbers(first.where("source IS NOT NULL"), [F.col("doc_id")], ["source"], "n").where("n <= 25")
    return n.select(F.concat("source", F.lit(":"), F.substring("sha", 1, 12)).alias("id"), "doc_id")


@query("s14_artifact_round_trip", f"WITH {LP}\n--\nSELECT 3 AS n, a, b, w, c FROM tri UNION ALL SELECT 2, NULL, b, w, c FROM bi UNION ALL SELECT 1, NULL, NULL, w, c FROM uni")
def _(s, d):
    path = os.path.join(checkpoint_dir(s), f"artifact-{os.path.basename(d.rstrip('/'))}")
    models.save_ngrams(model(s, d), path)
    m = models.load_ngrams(s, path)
    none = F.lit(None).cast("string")
    return m["tri"].select(F.lit(3).alias("n"), "a", "b", "w", "c").unionByName(m["bi"].select(F.lit(2).alias("n"), none.alias("a"), "b", "w", "c")).unionByName(m["uni"].select(F.lit(1).alias("n"), none.alias("a"), none.alias("b"), "w", "c"))


@query("s20_analyze", FLAGSHIP_SQL.replace("WITH es AS", "WITH es AS").replace("\nSELECT doc_id, sentences", ", fl AS (SELECT doc_id, sentences", 1) + ")\n--\nSELECT es.id, CASE WHEN text IS NULL OR trim(text, E' \\t\\n\\r') = '' THEN 400 WHEN length(text) > 40000 THEN 413 ELSE 200 END AS status, CASE WHEN length(text) <= 40000 THEN band END AS band FROM es LEFT JOIN fl ON es.id = fl.doc_id")
def _(s, d):
    e = es(s, d).select("id", "text")
    status = F.when(F.col("text").isNull() | (F.regexp_replace("text", r"\s+", "") == ""), 400).when(F.length("text") > 40_000, 413).otherwise(200)
    return e.select("id", status.alias("status")).join(flagship(s, d).select(F.col("doc_id").alias("id"), "band"), "id", "left").select("id", "status", F.when(F.col("status") == 200, F.col("band")).alias("band"))


@query("s24_licensed_bundles", f"WITH {SV}, {ES}, ok AS (SELECT e.id, e.text IS NULL AS missing, e.text FROM es e WHERE NOT EXISTS (SELECT 1 FROM source_registry r WHERE r.source_id = e.source_id AND NOT redistributable))\n--\nSELECT s.doc_id, count(*) AS spans, md5(string_agg(sentence_index || ':' || char_start || '-' || char_end, ';' ORDER BY sentence_index)) AS digest, any_value(ok.missing) AS missing_text FROM sv s JOIN ok ON s.doc_id = ok.id GROUP BY s.doc_id")
def _(s, d):
    closed = table(s, d, "source_registry").where("NOT redistributable").select("source_id")
    return corpus.bundles(sv(s, d), es(s, d), closed)


@query("s25_quotes", f"WITH {SV}, {ES}, q AS (SELECT doc_id, sentence_index, left(sv.text, 320) AS q, greatest(200, floor(0.35 * length(es.text))) AS most FROM sv JOIN es ON sv.doc_id = es.id WHERE sv.probability >= 0.9), r AS (SELECT *, sum(length(q)) OVER (PARTITION BY doc_id ORDER BY sentence_index) AS used FROM q)\n--\nSELECT doc_id, sentence_index, CASE WHEN used <= most THEN q END AS quote, NULL::VARCHAR AS text FROM r")
def _(s, d):
    return corpus.quotes(sv(s, d).where("probability >= 0.9"), es(s, d).select(F.col("id").alias("doc_id"), F.col("text").alias("whole")))


@query("s26_named_sets_capped", f"WITH {ES}, st(name, role) AS (VALUES ('fit', 'train'), ('audit', 'esl-eval'), ('audit', 'reference')), x AS (SELECT st.name, CASE WHEN e.authorship = 'machine' THEN 'generated' ELSE 'raw' END AS folder, e.source_id, e.id, row_number() OVER (PARTITION BY st.name, e.source_id ORDER BY e.id) AS r FROM es e JOIN st ON lower(trim(e.role)) = st.role WHERE e.source_id IS NOT NULL)\n--\nSELECT name, folder, source_id, id FROM x WHERE r <= 3")
def _(s, d):
    sets = s.createDataFrame([("fit", "train"), ("audit", "esl-eval"), ("audit", "reference")], "name string, set_role string")
    e = es(s, d).where("source_id IS NOT NULL").select("id", "source_id", "authorship", F.lower(F.trim("role")).alias("set_role")).join(F.broadcast(sets), "set_role")
    e = row_numbers(e, [F.col("id")], ["name", "source_id"], "n").where("n <= 3")
    return e.select("name", F.when(F.col("authorship") == "machine", "generated").otherwise("raw").alias("folder"), "source_id", "id")


@query("r2_r4_settled_budget", """WITH RECURSIVE e AS (SELECT event_id, date_trunc('day', ts) AS day, coalesce(value, 0.0) * 4 AS est, CASE event_id % 10 WHEN 3 THEN 0.0 WHEN 7 THEN coalesce(value, 0.0) * 4 ELSE coalesce(value, 0.0) * 3 END AS actual, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL),
r AS (SELECT event_id, day, n, est <= 7000 AS admitted, 0.0::DOUBLE AS spent_before, CASE WHEN est <= 7000 THEN greatest(0, 0 - est + est + actual - 0) ELSE 0 END::DOUBLE AS spent FROM e WHERE n = 1
UNION ALL SELECT e.event_id, e.day, e.n, r.spent + e.est <= 7000, r.spent, CASE WHEN r.spent + e.est <= 7000 THEN greatest(0, r.spent + e.actual) ELSE r.spent END FROM r JOIN e ON e.day = r.day AND e.n = r.n + 1)
--
SELECT event_id, admitted, spent_before FROM r""", "spent_before")
def _(s, d):
    e = table(s, d, "events").where("ts IS NOT NULL").withColumn("est", F.coalesce(F.col("value"), F.lit(0.0)) * 4)
    outcome = F.when(F.col("event_id") % 10 == 3, "failed_before").when(F.col("event_id") % 10 == 7, "failed_after").otherwise("ok")
    e = e.select("event_id", "ts", "est", outcome.alias("outcome"), (F.coalesce(F.col("value"), F.lit(0.0)) * 3).alias("actual"))
    return limiter.settled_budget(e).select("event_id", "admitted", "spent_before")
