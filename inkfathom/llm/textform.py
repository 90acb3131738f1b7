"""Visually identical text with different characters: one form for text that looks the same.

The work is done by DuckDB inside each Arrow batch (:func:`fold_batches`): embedded SQL with ``translate``,
``regexp_replace`` and ``nfc_normalize``. The tables that the SQL embeds are built here by rule from the
Unicode data of the interpreter.

Two forms are given:

* ``clean``: canonical composition, compatibility forms of the same look (width forms, ligatures, presentation
  forms, radicals), one space, one hyphen, no invisible characters. Readable, and safe to train on.
* ``folded``: ``clean`` with look-alike letters of other scripts brought to Latin. A key for comparisons; Russian or
  Greek text is not readable in it.

Case, punctuation, digits and line breaks are never changed. Superscripts, fractions, circled and mathematical
letters look different and stay. A null text stays null; an empty text stays empty.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin letter (or, in the last line, like a Cyrillic one).
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "а": "a", "с": "c", "ԁ": "d", "е": "e",
    "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "ү": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ꓐ": "B", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C",
    "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "Ӏ": "I", "ӏ": "l", "ı": "i", "Ԍ": "G", "Ӕ": "Æ", "ӕ": "æ", "Ә": "Ə", "ә": "ə", "Ө": "Ɵ", "ө": "ɵ", "Ӡ": "Ʒ", "ӡ": "ʒ", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L",
    "κ": "к", "ĸ": "к", "Γ": "Г", "Π": "П", "Φ": "Ф",
}
# Characters that take no place on the line (soft hyphen, zero-width and joining marks, direction marks,
# invisible operators, variation selectors, byte order mark).
INVISIBLE = "\uffa0­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Two of these keep a joiner between emoji, which changes the picture, while the other joiners go.
JOINER, KEPT = "‍", ""
_SAME_LOOK = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>"}
_RANGES = ((0x132, 0x133), (0x1C7, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0x2E80, 0x2FDF), (0xFB00, 0xFB4F), (0xFB50, 0xFDFB), (0xE33, 0xE33), (0xEB3, 0xEB3))


@functools.cache
def tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """One-to-one compatibility map, one-to-many compatibility map, look-alike map."""
    one, many = {}, {}
    for cp in range(0x80, 0x1F000):
        c = chr(cp)
        d = unicodedata.decomposition(c)
        if unicodedata.category(c) == "Zs":
            one[c] = " "
        elif d.startswith("<") and (d.split(" ", 1)[0] in _SAME_LOOK or any(a <= cp <= b for a, b in _RANGES)):
            to = unicodedata.normalize("NFKC", c)
            if c == "ﷺ" or " " in to or to in INVISIBLE or c in INVISIBLE:
                continue
            if to != c:
                (one if len(to) == 1 else many)[c] = to
    # Half-width voicing marks compose with the letter before them.
    one |= {"ﾞ": "゙", "ﾟ": "゚", "‐": "-", "‑": "-", "‒": "–"}
    looks = dict(LOOKALIKES)
    for base, latin in LOOKALIKES.items():
        for mark in range(0x300, 0x346):
            a, b = (unicodedata.normalize("NFC", x + chr(mark)) for x in (base, latin))
            if len(a) == len(b) == 1:
                looks[a] = b
    return one, many, looks


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@functools.cache
def fold_sql(column: str = "text") -> tuple[str, str]:
    """SQL expressions for the clean and the folded form of ``column``; the folded one reads the clean one as ``clean``."""
    one, many, looks = tables()
    emoji = f"regexp_replace({column}, '([\\x{{1F000}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]\\x{{FE0F}}?)\\x{{200D}}', '\\1{KEPT}', 'g')"
    # Characters of the first list without a partner in the second are removed.
    sql = f"translate({emoji}, {_quoted(''.join(one) + KEPT + INVISIBLE)}, {_quoted(''.join(one.values()) + JOINER)})"
    pattern = "[" + "".join(many) + "]"
    deep = sql
    for c, to in many.items():
        if c < "ﭐ":  # the Arabic ligatures, which are many, are written out before, by ligature_sql
            deep = f"replace({deep}, {_quoted(c)}, {_quoted(to)})"
    clean = f"nfc_normalize(CASE WHEN regexp_matches({column}, '{pattern}') THEN {deep} ELSE {sql} END)"
    # A look-alike and its accent may compose only once the letter is the Latin one.
    return clean, f"nfc_normalize(translate(clean, {_quoted(''.join(looks))}, {_quoted(''.join(looks.values()))}))"


@functools.cache
def ligature_sql(column: str = "text") -> str:
    """SQL expression that writes out the Arabic ligatures of ``column``, which :func:`fold_sql` leaves. They are tested for
    in two classes, lam-alef and the many others, and replaced only in texts that have one of the class."""
    many = tables()[1]
    sql = column
    for group in ([c for c in many if "ﻵ" <= c <= "ﻼ"], [c for c in many if c >= "ﭐ" and not "ﻵ" <= c <= "ﻼ"]):
        deep = sql
        for c in group:
            deep = f"replace({deep}, {_quoted(c)}, {_quoted(many[c])})"
        sql = f"(CASE WHEN regexp_matches({column}, '[{''.join(group)}]') THEN {deep} ELSE {sql} END)"
    return sql


def fold_python(text: str) -> str:
    """The folded form of one text, for operators that already hold it in Python; same tables, same steps."""
    if text.isascii():
        return text
    one, looks, touched = _translations()
    if not touched.search(text):
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(looks))
    if JOINER in text:
        import regex

        text = regex.sub(r"([\U0001F000-\U0001FAFF☀-➿]️?)‍", r"\1" + KEPT, text)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text.translate(one)).translate(looks))


@functools.cache
def _translations() -> tuple[dict, dict, re.Pattern]:
    one, many, looks = tables()
    first = str.maketrans(one | many | dict.fromkeys(INVISIBLE, "") | {KEPT: JOINER})
    touched = {c for c in [*one, *many, *looks, *INVISIBLE, KEPT] if ord(c) > 127}
    return first, str.maketrans(looks), re.compile(f"[{re.escape(''.join(sorted(touched)))}]")


#: Outer white space as the tables define it.
STRIP = r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$"


def fold_batches(select: str, schema: T.StructType):
    """A ``mapInArrow`` function that runs ``select`` over each batch in DuckDB.

    ``select`` reads the relation ``folded``: the batch's columns, ``stored`` (``text`` without outer white space),
    ``clean`` and ``folded`` (both without outer white space).
    """
    clean, folded = fold_sql("plain")
    strip = STRIP.replace("'", "''")
    sql = f"""
        WITH s AS (SELECT *, regexp_replace(text, '{strip}', '', 'g') AS stored FROM batch),
             p AS (SELECT *, {ligature_sql("stored")} AS plain FROM s),
             c AS (SELECT * EXCLUDE (plain), regexp_replace({clean}, '{strip}', '', 'g') AS clean FROM p),
             folded AS (SELECT *, {folded} AS folded FROM c)
        {select}
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                con.register("batch", pa.Table.from_batches([batch]))
                out = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                yield from out.cast(arrow).to_batches()
        finally:
            con.close()

    return run


def fold_text(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, stored, clean, folded) of each row; a null text gives nulls. Other columns of ``df`` are not read."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(c, T.StringType()) for c in ("stored", "clean", "folded"))])
    return df.select(key, F.col(column).alias("text")).mapInArrow(fold_batches(f'SELECT "{key}", stored, clean, folded FROM folded', schema), schema)


def look_keys(df: DataFrame, key: str = "id", column: str = "text") -> DataFrame:
    """(key, look, form): hashes of what a text looks like and of how it is stored. Rows with a null key or text are left out."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("look", T.StringType()), T.StructField("form", T.StringType())])
    rows = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(key, F.col(column).alias("text"))
    return rows.mapInArrow(fold_batches(f'SELECT "{key}", sha256(folded) AS look, sha256(stored) AS form FROM folded', schema), schema)


def same_look_pairs(df: DataFrame, key: str = "id", column: str = "text") -> DataFrame:
    """(id_a, id_b): rows whose stored texts differ but look the same, smaller key first, each pair once.

    Rows with the same key are one row (its smallest stored form counts). Null keys and null texts are in no pair;
    texts that are empty once invisible characters are gone look the same as each other. Stored forms, not rows, are
    paired, so a group of exact copies, however large, is never compared within itself.
    """
    keys = look_keys(df, key, column).groupBy(key).agg(F.min_by("look", "form").alias("look"), F.min("form").alias("form"))
    forms = keys.groupBy("look", "form").agg(F.count("*").alias("n"))
    many = forms.groupBy("look").agg(F.count("*").alias("forms")).where("forms > 1").select("look")
    varied = keys.join(many, "look", "left_semi")
    f = varied.select("look", "form").distinct()
    pairs = f.alias("x").join(f.alias("y"), F.expr("x.look = y.look AND x.form < y.form")).select(F.col("x.look").alias("look"), F.col("x.form").alias("form_a"), F.col("y.form").alias("form_b"))
    a = varied.select(F.col("look"), F.col("form").alias("form_a"), F.col(key).alias("ka"))
    b = varied.select(F.col("look"), F.col("form").alias("form_b"), F.col(key).alias("kb"))
    out = pairs.join(a, ["look", "form_a"]).join(b, ["look", "form_b"])
    return out.select(F.least("ka", "kb").alias("id_a"), F.greatest("ka", "kb").alias("id_b"))
