"""Queries of the operators for training data, and their SQL where SQL can state them on whole tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkfathom.llm import bpe, components, crosssplit, graydup, leakage, personal, sentences, shingles, textform, truncation
from inkfathom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _essays(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "essays")


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: truncation.truncated_essays(_essays(s, d)),
        "p1_sources": lambda s, d: truncation.truncation_by_source(_essays(s, d)),
        "p1_limits": lambda s, d: truncation.storage_limits(_essays(s, d)),
        "p2_found": lambda s, d: components.essay_groups(_essays(s, d)),
        "p2_splits": lambda s, d: components.verdict_splits(_essays(s, d), table(s, d, "sentence_verdicts"), table(s, d, "split_targets")),
        "p3_found": lambda s, d: sentences.sentences_found(_essays(s, d)),
        "p4_found": lambda s, d: graydup.near_duplicate_pairs(_essays(s, d)),
        "p4_classes": lambda s, d: graydup.near_duplicate_classes(table(s, d, "documents")),
        "p5_found": lambda s, d: textform.same_look_pairs(_essays(s, d)),
        "p6_found": lambda s, d: crosssplit.cross_split_pairs(_essays(s, d)),
        "p7_ids": lambda s, d: bpe.encode_texts(table(s, d, "documents")),
        "p8_found": lambda s, d: leakage.leaked_items(table(s, d, "documents"), table(s, d, "heldout_items")),
        "p8_items": lambda s, d: leakage.leaks_by_item(table(s, d, "documents"), table(s, d, "heldout_items")),
        "p9_found": lambda s, d: personal.personal_spans(table(s, d, "documents")),
        "p9_redacted": lambda s, d: personal.redacted(table(s, d, "documents")),
        "p6_report": lambda s, d: crosssplit.cross_split_report(_essays(s, d)),
    }


def _folded_essays() -> str:
    """SQL of the relation f: one row per essay with its stored and its folded form."""
    clean, folded = textform.fold_sql("stored")
    strip = textform.STRIP.replace("'", "''")
    return f"""s AS (SELECT id, min(regexp_replace(text, '{strip}', '', 'g')) AS stored FROM essays WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id),
c AS (SELECT *, regexp_replace({clean}, '{strip}', '', 'g') AS clean FROM s), f AS (SELECT *, {folded} AS folded FROM c)"""


def _similar_essays() -> str:
    """SQL of the relation p: pairs of essays (a, b), a < b, with a similarity of at least 0.5."""
    return f"""{_folded_essays()}, w AS (SELECT id, regexp_extract_all(lower(folded), '{shingles.WORD}') AS w FROM f),
t AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM w WHERE len(w) >= 3),
n AS (SELECT id, count(*) AS n FROM t GROUP BY id), o AS (SELECT x.id AS a, y.id AS b, count(*) AS o FROM t x JOIN t y ON x.t = y.t AND x.id < y.id GROUP BY ALL),
p AS (SELECT a, b FROM o JOIN n na ON a = na.id JOIN n nb ON b = nb.id WHERE 2 * o >= na.n + nb.n - o)"""


def _look_rows() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """What characters look like, straight from the Unicode data: compatibility forms of the same look, spaces and
    characters that take no place; and look-alike letters. Not the expressions that the operator runs."""
    same, rows = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>"), []
    for c in map(chr, range(0x80, 0x1F000)):
        d, kc = unicodedata.decomposition(c), unicodedata.normalize("NFKC", c)
        listed = any(a <= ord(c) <= b for a, b in textform._RANGES)
        if c in textform.INVISIBLE or kc in textform.INVISIBLE and d:
            rows.append((c, ""))
        elif unicodedata.category(c) == "Zs":
            rows.append((c, " "))
        elif c in "‐‑‒":
            rows.append((c, "–" if c == "‒" else "-"))
        elif c in "ﾞﾟ":
            rows.append((c, "゙" if c == "ﾞ" else "゚"))
        elif d.startswith("<") and (d.split()[0] in same or listed) and kc != c and " " not in kc and c != "ﷺ":
            rows.append((c, kc))
    looks = {unicodedata.normalize("NFC", a + m): unicodedata.normalize("NFC", b + m) for a, b in textform.LOOKALIKES.items() for m in ["", *map(chr, range(0x300, 0x346))]}
    return [*rows, ("\ue000", "\u200d")], [(a, b) for a, b in looks.items() if len(a) == len(b) == 1]


def _same_look_sql() -> str:
    """p5_found character by character: each is looked up in a table and the text is put together again."""
    values = lambda rows: ", ".join(f"({textform._quoted(a)}, {textform._quoted(b)})" for a, b in rows)
    same, looks = _look_rows()
    strip = textform.STRIP.replace("'", "''")
    chars = lambda source, column, table: f"(SELECT id, string_agg(coalesce(t, c), '' ORDER BY i) AS x FROM (SELECT id, unnest(regexp_extract_all({column}, '(?s).')) AS c, generate_subscripts(regexp_extract_all({column}, '(?s).'), 1) AS i FROM {source}) LEFT JOIN {table} USING (c) GROUP BY id)"
    return f"""WITH same(c, t) AS (VALUES {values(same)}), looks(c, t) AS (VALUES {values(looks)}),
s AS (SELECT id, min(regexp_replace(text, '{strip}', '', 'g')) AS stored FROM essays WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id),
e AS (SELECT id, regexp_replace(stored, '([\\x{{1F000}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]\\x{{FE0F}}?)\\x{{200D}}', '\\1\ue000', 'g') AS x FROM s),
a AS (SELECT id, regexp_replace(nfc_normalize(x), '{strip}', '', 'g') AS x FROM {chars("e", "x", "same")}), b AS (SELECT id, nfc_normalize(x) AS look FROM {chars("a", "x", "looks")}),
f AS (SELECT s.id, stored, coalesce(look, '') AS look FROM s LEFT JOIN b USING (id))
SELECT p.id AS id_a, q.id AS id_b FROM f p JOIN f q ON p.look = q.look AND p.id < q.id AND p.stored <> q.stored"""


_CLASSES = """WITH d AS (SELECT doc_id AS id, text AS stored FROM documents WHERE text IS NOT NULL), {fold}, w AS (SELECT id, regexp_extract_all(lower(folded), '{word}') AS w FROM f),
t AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS t FROM w WHERE len(w) >= 5), g AS (SELECT id, list(t ORDER BY t) AS l, count(*) AS n FROM t GROUP BY id),
c AS (SELECT min(id) AS cid, l, n, count(*) AS copies FROM g GROUP BY l, n), tc AS (SELECT cid, n, unnest(l) AS t FROM c), o AS (SELECT x.cid AS a, y.cid AS b, x.n AS na, y.n AS nb, count(*) AS o FROM tc x JOIN tc y ON x.t = y.t AND x.cid < y.cid GROUP BY ALL),
p AS (SELECT a, b FROM o WHERE o >= 0.8 * (na + nb - o)), k AS (SELECT cid, count(*) AS links FROM (SELECT a AS cid FROM p UNION ALL SELECT b FROM p) GROUP BY cid)
SELECT x.doc_id, c.cid AS class_id, coalesce(copies, 0) AS copies, coalesce(links, 0) AS links FROM (SELECT DISTINCT doc_id FROM documents) x LEFT JOIN g ON x.doc_id = g.id LEFT JOIN c ON g.l = c.l LEFT JOIN k ON c.cid = k.cid"""


def _classes_sql() -> str:
    clean, folded = textform.fold_sql("plain")
    strip = textform.STRIP.replace("'", "''")
    fold = f"""e AS (SELECT id, regexp_replace(stored, '{strip}', '', 'g') AS stored FROM d), q AS (SELECT *, {textform.ligature_sql("stored")} AS plain FROM e), r AS (SELECT *, regexp_replace({clean}, '{strip}', '', 'g') AS clean FROM q), f AS (SELECT id, {folded} AS folded FROM r)"""
    return _CLASSES.replace("{fold}", fold).replace("{word}", shingles.WORD)


_ROLES = "r AS (SELECT id, min(lower(regexp_replace(role, '^\\s+|\\s+$', '', 'g'))) AS role, min(source_id) AS source_id FROM essays GROUP BY id)"
_CROSS = "(ra.role = 'train' AND rb.role IN ('esl-eval', 'unseen-generator', 'ablation') OR rb.role = 'train' AND ra.role IN ('esl-eval', 'unseen-generator', 'ablation'))"


def oracle_sql() -> dict[str, str]:
    cross = f"x AS (SELECT a, b FROM p JOIN r ra ON a = ra.id JOIN r rb ON b = rb.id WHERE {_CROSS})"
    return {
        "p2_found": """WITH RECURSIVE k AS (SELECT DISTINCT id, '0' || source_id AS x FROM essays WHERE source_id IS NOT NULL
UNION SELECT id, '2' || lower(trim(meta->>'author')) FROM essays WHERE trim(meta->>'author') <> '' UNION SELECT e.id, '1' || (e.meta->>'base_doc_id') FROM essays e WHERE e.meta->>'base_doc_id' IN (SELECT id FROM essays) UNION SELECT id, '1' || id FROM essays),
e AS (SELECT '1' || id AS a, x AS b FROM k UNION SELECT x, '1' || id FROM k), reach AS (SELECT a AS node, b AS other FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.other = e.a)
SELECT node[2:] AS id, min(other)[2:] AS group_id FROM reach WHERE node LIKE '1%' GROUP BY node""",
        "p4_found": f"WITH {_similar_essays()} SELECT a AS id_a, b AS id_b FROM p",
        "p5_found": _same_look_sql(),
        "p4_classes": _classes_sql(),
        "p6_found": f"WITH {_similar_essays()}, {_ROLES}, {cross} SELECT a AS id_a, b AS id_b FROM x",
        "p6_report": f"WITH {_similar_essays()}, {_ROLES}, {cross}, h AS (SELECT a AS id FROM x UNION SELECT b FROM x) SELECT role, source_id, count(*) AS essays, count(h.id) AS overlapping FROM r LEFT JOIN h USING (id) WHERE role IN ('esl-eval', 'unseen-generator', 'ablation') GROUP BY ALL",
    }
