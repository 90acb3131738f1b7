"""Paragraphs, sentences, words and candidate tokens of a text as rows with offsets.

Offsets are 0-based, half-open and count code points. Each text is read once, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words before a full stop that does not end a sentence.
ABBREVIATIONS = """mr mrs ms dr prof sr jr st rev hon gen col capt lt sgt gov pres supt
inc ltd co corp dept univ assn bros
jan feb mar apr jun jul aug sep sept oct nov dec
mon tue tues wed thu thurs fri sat sun
vs etc al ca cf ed eds vol no pp fig figs approx""".split()
_KNOWN = frozenset(ABBREVIATIONS)
# What ends a sentence, what separates paragraphs, and dotted abbreviations.
TERMINATOR, BLANK, DOTTED = r"[.!?…]+[\"'”’)\]]*", r"\n\s*\n", r"(?:[A-Za-z]\.){2,}"
_STOP = re.compile(rf"({TERMINATOR})(?=(\s+|$))")
_BLANK, _DOTTED, _WORD = re.compile(BLANK), re.compile(DOTTED), re.compile(r"\S+")


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    piece = text[a:b]
    return a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())


def paragraph_spans(text: str) -> list[tuple[int, int]]:
    """What lies between blank lines, trimmed; empty ones are left out."""
    cuts = [0, *(x for m in _BLANK.finditer(text) for x in m.span()), len(text)]
    spans = (_trim(text, a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True))
    return [(a, b) for a, b in spans if a < b]


def _guarded(text: str, first: int, dot: int) -> bool:
    """Whether the full stop at ``dot`` closes an abbreviation or an initial. (T4, the point of a decimal, has
    no white space behind it and is no stop at all.)"""
    i = dot
    while i > first and (text[i - 1].isalpha() or text[i - 1] == "."):
        i -= 1
    word = text[i : dot + 1]
    initial = dot > first and text[dot - 1].isupper() and (dot - 1 == first or not text[dot - 2].isalpha())
    return initial or _DOTTED.fullmatch(word) is not None or word.rstrip(".").lower() in _KNOWN


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Sentences within paragraphs. A stop counts at the end, before a line break, or before anything but a
    lower-case letter; what follows the last one is a sentence."""
    out = []
    for first, last in paragraph_spans(text):
        start = first
        for m in _STOP.finditer(text, first, last):
            gap, after = m[2], text[m.end() + len(m[2]) : m.end() + len(m[2]) + 1]
            if m[0][0] == "." and _guarded(text, first, m.start()):
                continue
            if m.end() < last and "\n" not in gap and after.isalpha() and after.islower():
                continue
            out.append((start, m.end()))
            start = m.end()
        out.append((start, last))
    return [(a, b) for a, b in (_trim(text, a, b) for a, b in out) if a < b]


def word_spans(text: str) -> list[tuple[int, int]]:
    """Runs without white space."""
    return [m.span() for m in _WORD.finditer(text)]


def tile(text: str, tokens: list[str]) -> list[tuple[int, int]] | None:
    """(start, end) of candidate tokens that cover the text exactly, one after the other, in the given order; a token that
    does not fit may be left out. Of several coverings the one that leaves out fewest; None if there is none.

    A table over (place in the text, token) with back-pointers; only places that tokens reach are held.
    """
    reached: dict[int, tuple[int, tuple | None]] = {0: (0, None)}  # place: tokens left out so far, last step
    for t in tokens:
        nxt: dict[int, tuple[int, tuple | None]] = {}
        for place, (left_out, step) in reached.items():
            for to, cost, how in ((place, left_out + 1, step), (place + len(t), left_out, (place, place + len(t), step))):
                if (to == place or (t and text.startswith(t, place))) and (to not in nxt or cost < nxt[to][0]):
                    nxt[to] = (cost, how)
        reached = nxt
    if len(text) not in reached:
        return None
    out, step = [], reached[len(text)][1]
    while step:
        out.append((step[0], step[1]))
        step = step[2]
    return out[::-1]


def _spans(df: DataFrame, keys: list[str], column: str, index: str, find: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    names = [*keys, index, "char_start", "char_end", "text"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(*k, i, a, b, t[a:b]) for *k, t in part.itertuples(index=False, name=None) for i, (a, b) in enumerate(find(t))]
            yield pd.DataFrame(rows, columns=names)

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    texts = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_text"))
    return texts.mapInPandas(run, f"{types}, `{index}` int, char_start int, char_end int, text string")


def paragraphs(df: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """(keys, paragraph_index, char_start, char_end, text). Null and blank texts have no rows."""
    return _spans(df, keys, column, "paragraph_index", paragraph_spans)


def sentences(df: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """(keys, sentence_index, char_start, char_end, text). Null and blank texts have no rows."""
    return _spans(df, keys, column, "sentence_index", sentence_spans)


def words(df: DataFrame, keys: list[str], column: str = "text", skip: int = 3) -> DataFrame:
    """(keys, word_index, char_start, char_end, text) without the first ``skip`` words, which lack context."""
    return _spans(df, keys, column, "word_index", word_spans).where(F.col("word_index") >= skip)
