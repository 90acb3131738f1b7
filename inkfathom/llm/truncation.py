"""Text cut off by field limits or in transfer.

Each text's length is taken under several encodings: characters, UTF-8 and UTF-16, with entities escaped, as JSON
(ASCII and UTF-8), with CRLF line ends. Grouping by each length, over all rows and within each source, shows hidden
storage limits: lengths far more frequent than their neighbours, at which texts end openly. Then endings are inspected.

A text is cut if, without a closing line of its own,

* it ends openly: no closing mark, or a mark that an abbreviation, an initial or a list leaves open, or
* a mark of the system stands for the rest ("[...]", an ellipsis on a broken word), or
* it ends well, but n_words tells of clearly more words than there are, or
* it ends well exactly at a limit of its source, which cuts the source's other texts and which none passes.

What the corpus says about an ending (is its last line a closing line elsewhere, is its last word a word, do its last
letters end a segment) is counted over different texts, however often each is delivered, and compared as shares; the
only absolute numbers are the few texts below which there is no evidence at all. Languages without closing marks (Thai)
are judged by whether their last letters end a segment elsewhere in the corpus.

Two passes over the texts: the first takes features, the second counts only what endings of the first ask for. What is
asked for is broadcast as a filter of ``WANTED`` bytes whatever the size of the corpus; values that share its places are
counted, too, and drop out of the join.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfathom.llm.textform import fold_python
from inkfathom.session import cut_lineage

ENCODINGS = ("chars", "utf8", "utf16", "entity_chars", "entity_utf8", "json_ascii", "json_utf8", "crlf_chars", "crlf_utf8")
#: A limit holds at least this many different texts, this many times the mean of the lengths around it, and ends openly this often.
LIMIT_ROWS, LIMIT_RATIO, LIMIT_OPEN, AROUND = 5, 4.0, 0.6, 10
#: A source's limit cuts this many different texts, and at most one longer text for LONGER of them.
SOURCE_ROWS, LONGER = 3, 3
#: n_words is evidence from this many words and this factor on; tools differ by less.
MORE_WORDS, MORE_FACTOR = 4, 1.04
#: A last line that ends this many texts which differ before it is a closing line, unless more texts go on after it.
LINE_TEXTS = 3
#: A word is whole if this many texts have it inside, and this share of all rows.
WORD_TEXTS, WORD_SHARE = 3, 5e-5
#: An ellipsis, or the end of a Thai segment, is an author's own if this many texts have it inside, and this share of those that begin or spell alike.
OWN_TEXTS, OWN_SHARE = 2, 0.002
WANTED = 1 << 20

_MARK = regex.compile(r"(?:\s*(?:\[(?:\.\.\.|…|truncated|cut|more)\]|\((?:\.\.\.|…|truncated)\)|<(?:truncated|more|cut)>)|(?:read|see) more\W*|\bcontinued\W*)\Z", regex.I)
_DOTS = regex.compile(r"(?:\.\.\.|…)\Z")
_END = regex.compile(r"[.!?…。！？｡؟।॥۔‽][\"'”’»)\]』」）】》〉“]*(?:[^\S\n][»”])?\Z")
_OPEN_TAIL = regex.compile(
    r"(?:(?<![\p{L}\p{M}\p{N}])(?:Mr|Mrs|Ms|Dr|Prof|St|No|Nr|Fig|approx|vs|e\.g|i\.e|e|i|Sr|Sra|núm|ej|ex|env|z|d|u|M|Mme|т|р|डॉ|د)|(?<![\p{L}\p{M}\p{N}])\p{Lu}|[¿¡(\[«“„「『]\W*)\.?\Z"
)
_CLOSING = regex.compile(
    r"(?:[—–~*-]+\s*\p{L}[\p{L}.'’ -]{0,40}[\s~*-]*|\(?\s*\d[\d.,]*\s*\p{L}+\s*\)?|\p{L}+(?: \p{L}+)?\s*:\s*\d[\d.,]*|\p{L}+ \d+ \p{L}+ \d+|(?i:the end|end|fin|fine|ende|конец|完|終|終わり|समाप्त|النهاية|จบ)|(?i:thank(?:s| you)\b.{0,40}|submitted(?: \S+){3,9})|#+|\*+)[.!]?\Z"
)
# A closing line does not stop at one of these.
_UNDONE = regex.compile(r"(?i)\b(?:for|the|to|of|and|a|my|your|in|on|at|by)\Z")
_BLANK = regex.compile(r"\n[^\S\n]*\n\s*")
_THAI = regex.compile(r"[\p{Thai}]\Z")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-]+[^\W\d_]+)*")
_MARKED = regex.compile(r"[\p{L}\p{M}'’-]+")
_SENTENCE = regex.compile(r"(?:(?<=[.!?]\s)|(?<=\n)|\A)([^\s.!?]+ [^\s.!?]+)")
_DOTTED = regex.compile(r"(?:(?<=[.!?]\s)|(?<=\n)|\A)([^\s.!?]+ [^\s.!?]+)[^.!?\n]*(?:\.\.\.|…)(?=\s)")
_THAI_END = regex.compile(r"([\p{Thai}]{4})(?=\s+[^\s\d])")
_THAI_RUN = regex.compile(r"[\p{Thai}]{5,}")


def lengths(t: str) -> tuple[int, ...]:
    """Lengths of a text under ENCODINGS, in their order."""
    raw = len(t.encode("utf-8", "surrogatepass"))
    entity = html.escape(t)
    lines = t.count("\n") - t.count("\r\n")
    return (len(t), raw, len(t) + sum(c > "￿" for c in t) if not t.isascii() else len(t), len(entity), raw + len(entity) - len(t), len(json.dumps(t)) - 2,
            len(json.dumps(t, ensure_ascii=False).encode("utf-8", "surrogatepass")) - 2, len(t) + lines, raw + lines)


def _number(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _skeleton(line: str) -> str:
    return re.sub(r"\d+", "#", line) if any(c.isdigit() for c in line) else line


def _features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for key, source, text, n in zip(part["key"], part["source_id"], part["text"], part["n_words"], strict=True):
            t = fold_python(text).strip()
            words = t.split()
            cut = t.rfind("\n")
            blocks = _BLANK.split(t) if cut >= 0 else [t]
            line = blocks[-1] if len(blocks) > 1 and "\n" not in blocks[-1] else None
            # Patterns of the end read from a little before the last letter or digit on.
            last_letter = next((i for i in range(len(t) - 1, -1, -1) if t[i].isalnum()), 0)
            end = t[max(0, last_letter - 60) :]
            mark, dots, thai = bool(_MARK.search(end)), t.endswith(("...", "…")), bool(_THAI.search(end))
            closing = bool(line and _CLOSING.match(line) and not _UNDONE.search(line) and not mark and not dots)
            ended = bool(_END.search(end)) and not _OPEN_TAIL.search(end.rstrip("\"'”’»)]"))
            more = n == n and n is not None and n >= len(words) + MORE_WORDS and n >= MORE_FACTOR * len(words)
            last = words[-1].rstrip(".…") if dots else None
            first = " ".join(regex.split(r"(?<=[.!?。！？؟।])\s+", blocks[-1])[-1].split()[:2]) if dots else None
            skeleton = _skeleton(line) if line and " " in line and not (_END.search(end) or mark or dots) else None
            body = _number(" ".join(" ".join(blocks[:-1]).split())) if skeleton else None
            dotted = list(set(_DOTTED.findall(t))) if "..." in t or "…" in t else None
            rows.append((key, source, _number(t), list(lengths(text)), closing, mark, dots, thai, ended, bool(more), last, first, dotted, skeleton, body, t[-4:] if thai else None, not t))
        yield pd.DataFrame(rows, columns=["id", "source_id", "h", "lens", "closing", "mark", "dots", "thai", "ended", "more", "last", "first", "dotted", "skeleton", "body", "tail", "blank"]).astype({"body": "Int64"})


_SCHEMA = "id string, source_id string, h bigint, lens array<int>, closing boolean, mark boolean, dots boolean, thai boolean, ended boolean, more boolean, last string, first string, dotted array<string>, skeleton string, body bigint, tail string, blank boolean"


def _opening(line: str) -> str:
    """What lines are asked for by: their first two words."""
    at = line.find(" ")
    return line[: line.find(" ", at + 1)] if at >= 0 and line.find(" ", at + 1) >= 0 else line


def _wanted(rows: DataFrame, lines: DataFrame, dotted: DataFrame) -> tuple[bytes, int]:
    """The filter over all values asked for, and the length of the longest line among them."""
    two = F.regexp_extract("skeleton", r"^[^ ]* [^ ]*", 0)
    values = rows.select(F.explode(F.array("last", "tail")).alias("v")).unionByName(dotted.select(F.col("first").alias("v"))).withColumn("n", F.lit(None).cast("int"))
    values = values.unionByName(lines.select(F.explode(F.array(two, "skeleton")).alias("v"), F.length("skeleton").alias("n"))).where("v IS NOT NULL AND v <> ''")
    got = values.groupBy((F.crc32("v") % WANTED).cast("int").alias("at")).agg(F.max("n").alias("n")).toArrow()  # at most WANTED rows
    places = bytearray(WANTED)
    for at in got["at"].to_pylist():
        places[at] = 1
    return bytes(places), max((n for n in got["n"].to_pylist() if n), default=0)


def _evidence(shared):
    """(kind, value, h, n): texts h with sentences or paragraphs that begin so, or with Thai letters inside them or at the
    end of a segment; and for each word inside texts, the number n of rows in the task, with up to WORD_TEXTS of their h."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, longest = shared.value
        known: dict[str, bool] = {}
        counts: dict[str, list] = {}

        def asked(v: str) -> bool:
            hit = known.get(v)
            if hit is None:
                if len(known) > 500_000:
                    known.clear()
                hit = known[v] = bool(places[zlib.crc32(v.encode("utf-8", "surrogatepass")) % WANTED])
            return hit

        def words_so_far() -> pd.DataFrame:
            rows = [("word", w, h, n if i == 0 else 0) for w, (n, hs) in counts.items() for i, h in enumerate(hs)]
            counts.clear()
            return pd.DataFrame(rows, columns=["kind", "value", "h", "n"])

        for part in parts:
            rows = []
            for text in part["text"]:
                t = fold_python(text).strip()
                h = _number(t)
                words = _WORDS.findall(t) if t.isascii() else _MARKED.findall(t)
                for w in set(words[:-1]):
                    if asked(w):
                        c = counts.setdefault(w, [0, set()])
                        c[0] += 1
                        if len(c[1]) < WORD_TEXTS:
                            c[1].add(h)
                found = {("first", m) for m in _SENTENCE.findall(t) if asked(m)}
                for b in _BLANK.split(t) if longest and "\n" in t else [t] if longest else ():
                    head = _skeleton(b[: longest + 40])
                    opening = _opening(head)
                    if asked(opening):
                        found.update(("start", head[:i]) for i in range(len(opening), min(len(head), longest + 1)) if head[i] == " " and asked(head[:i]))
                if thai := _THAI_RUN.findall(t):
                    found.update(("tail", m) for m in _THAI_END.findall(t) if asked(m))
                    found.update(("gram", g) for r in thai for i in range(len(r) - 4) if asked(g := r[i : i + 4]))
                rows += [(k, v, h, 1) for k, v in found]
            yield pd.DataFrame(rows, columns=["kind", "value", "h", "n"])
            if len(counts) > 200_000:
                yield words_so_far()
        yield words_so_far()

    return run


def essay_endings(essays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, limits): what is known of each delivered row's ending, with flags ``at_limit`` and ``cut``; and the limits
    found, as (source_id, encoding, length, n, open_share), source_id null for those of the whole table."""
    texts = essays.where("id IS NOT NULL AND text IS NOT NULL").select(F.col("id").alias("key"), "source_id", "text", F.col("n_words").cast("double").alias("n_words"))
    rows = cut_lineage(texts.mapInPandas(_features, _SCHEMA))
    lines = rows.where("skeleton IS NOT NULL").groupBy("skeleton").agg(F.count_distinct("body").alias("line_n")).where(f"line_n >= {LINE_TEXTS}")
    lines = cut_lineage(lines)
    dotted = rows.where("dotted IS NOT NULL").select("h", F.explode("dotted").alias("first")).distinct().groupBy("first").agg(F.count("*").alias("dotted_n"))
    dotted = cut_lineage(dotted.where(f"dotted_n >= {OWN_TEXTS}").join(rows.where("dots").select("first").distinct(), "first", "left_semi"))
    shared = essays.sparkSession.sparkContext.broadcast(_wanted(rows, lines, dotted))
    seen = texts.select("text").mapInPandas(_evidence(shared), "kind string, value string, h bigint, n bigint").groupBy("kind", "value", "h").agg(F.sum("n").alias("n"))
    seen = cut_lineage(seen.groupBy("kind", "value").agg(F.count("*").alias("texts"), F.sum("n").alias("rows")))
    of = lambda kind, name, col: seen.where(F.col("kind") == kind).select(F.col("value").alias(col), F.col("texts").alias(name))
    lines = lines.join(of("start", "start_n", "skeleton"), "skeleton", "left").where("line_n > coalesce(start_n, 0)").select("skeleton", F.lit(True).alias("known_line"))
    own = lambda some, all_: (F.coalesce(some, F.lit(0)) >= OWN_TEXTS) & (F.coalesce(some, F.lit(0)) >= OWN_SHARE * F.coalesce(all_, F.lit(0)))
    # Words and segment ends are looked up only for rows whose ending turns on them.
    whole = seen.where("kind = 'word'").where((F.col("texts") >= WORD_TEXTS) & (F.col("rows") >= WORD_SHARE * rows.count())).select(F.col("value").alias("last"), F.lit(True).alias("whole"))
    trails = dotted.join(of("first", "first_n", "first"), "first", "left").where(own(F.col("dotted_n"), F.col("first_n"))).select("first", F.lit(True).alias("trails"))
    ellipses = rows.where("dots").select("id", "h", "last", "first").distinct().join(whole, "last", "left").join(trails, "first", "left")
    ellipses = ellipses.where("whole IS NULL OR trails IS NULL").select("id", "h", F.lit(True).alias("broken"))
    tails = of("tail", "tail_n", "tail").join(of("gram", "gram_n", "tail"), "tail", "left").where(own(F.col("tail_n"), F.col("gram_n"))).select("tail", F.lit(True).alias("known_tail"))
    r = rows.join(lines, "skeleton", "left").join(ellipses.distinct(), ["id", "h"], "left").join(tails, "tail", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    closed_line = F.col("closing") | flag("known_line")
    is_open = F.col("mark") | flag("broken") | (F.col("thai") & ~flag("known_tail")) | (~F.col("ended") & ~F.col("thai"))
    r = r.withColumn("open", ~closed_line & is_open & ~F.col("blank"))
    r = r.withColumn("evident", F.col("open") | (~closed_line & F.col("more") & ~F.col("thai")))
    r = cut_lineage(r.select("id", "source_id", "h", "lens", "open", "evident", closed_line.alias("closed_line")))
    # Counts of different texts by source, encoding and length; all further steps work on these.
    each = r.select("source_id", "h", "open", "evident", F.posexplode("lens").alias("e", "len"))
    different = each.groupBy("e", "len", "source_id", "h").agg(F.max("open").alias("open"), F.max("evident").alias("evident"))
    by_source = cut_lineage(different.groupBy("source_id", "e", "len").agg(F.count("*").alias("n"), F.sum(F.col("open").cast("int")).alias("open_n"), F.sum(F.col("evident").cast("int")).alias("cut_n")))
    every = by_source.groupBy("e", "len").agg(F.sum("n").alias("n"), F.sum("open_n").alias("open_n"))

    def piles(counts: DataFrame, *by: str) -> DataFrame:
        near = W.partitionBy(*by, "e").orderBy("len").rangeBetween(-AROUND, AROUND)
        return counts.withColumn("rest", (F.sum("n").over(near) - F.col("n")) / (2 * AROUND)).where(f"n >= {LIMIT_RATIO} * rest AND open_n >= {LIMIT_OPEN} * n")

    after = W.partitionBy("source_id", "e").orderBy("len").rowsBetween(1, W.unboundedFollowing)
    longer = by_source.where("source_id IS NOT NULL").withColumn("longer", F.coalesce(F.sum("n").over(after), F.lit(0)))
    per = longer.where(f"cut_n >= {SOURCE_ROWS} AND {LONGER} * longer <= cut_n")
    hit = r.select("id", "source_id", F.posexplode("lens").alias("e", "len")).join(per.select("source_id", "e", "len"), ["source_id", "e", "len"], "left_semi").groupBy("id").agg(F.lit(True).alias("at_limit"))
    r = r.join(hit, "id", "left").withColumn("at_limit", flag("at_limit"))
    own_piles = piles(by_source.where("source_id IS NOT NULL"), "source_id").where(f"n >= {LIMIT_ROWS}")
    limits = piles(every).where(f"n >= {LIMIT_ROWS}").select(F.lit(None).cast("string").alias("source_id"), "e", "len", "n", "open_n").unionByName(own_piles.select("source_id", "e", "len", "n", "open_n"))
    names = F.array(*map(F.lit, ENCODINGS))
    return r.withColumn("cut", F.col("evident") | (F.col("at_limit") & ~F.col("closed_line"))), limits.select("source_id", names[F.col("e")].alias("encoding"), F.col("len").alias("length"), "n", F.round(F.col("open_n") / F.col("n"), 4).alias("open_share"))


def truncated_essays(essays: DataFrame) -> DataFrame:
    """(id) of the essays whose text was cut. Null texts and blank texts are not cut; of several rows with one id one is enough."""
    return essay_endings(essays)[0].where("cut").select("id").distinct()


def truncation_by_source(essays: DataFrame) -> DataFrame:
    """(source_id, essays, cut, share): how often each source truncates; essays without a source form the null source."""
    rows = essay_endings(essays)[0].groupBy("id").agg(F.min("source_id").alias("source_id"), F.max(F.col("cut").cast("int")).alias("cut"))
    return rows.groupBy("source_id").agg(F.count("*").alias("essays"), F.sum("cut").alias("cut"), F.round(F.avg("cut"), 6).alias("share"))


def storage_limits(essays: DataFrame) -> DataFrame:
    """(source_id, encoding, length, n, open_share): the lengths at which different texts pile up, under each encoding; over
    all rows (null source_id) and within each source, against the lengths around in the same rows."""
    return essay_endings(essays)[1]
