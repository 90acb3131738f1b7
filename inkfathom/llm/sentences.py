"""Sentence boundaries across languages and scripts: cascading segmentation rule tables.

A rule is a pair of regular expressions, one for what stands before a position and one for what follows, and says
break or no break. For each candidate position the tables of the language's cascade are read in order; the first rule
that matches decides, and a position that no rule matches is no break. Candidates are the ends of runs of closing
marks and the spaces of Thai; blank lines are cut first.

Rules read a shadow of the text: width forms and look-alike letters brought to one form, combining accents composed,
invisible characters left out, with a map back to the stored code points. Spans are half-open code-point offsets of
the text as stored and hold no outer white space.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.textform import INVISIBLE, tables

OPEN = "\"'“„‘«»‹「『（(【《〈[¿¡"
CLOSE = "\"'”’»›)\\]』」）】》〉"
TERMINAL = ".!?…。！？｡؟।॥۔‽."
CASELESS = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Arabic}\p{Devanagari}]"
BLANK = regex.compile(r"(?:\r\n|[\n\r ])[^\S\n\r  ]*(?:\r\n|[\n\r ])\s*| \s*")


@dataclass(frozen=True)
class Rule:
    """``quote``: the rule holds only where the sentence so far begins with an opening mark."""

    breaks: bool
    before: str
    after: str
    quote: bool = False


# Abbreviations by language; of TITLES a word always follows, of NUMBERED a number, of INNER mostly
# something in the same sentence, even with a capital.
TITLES = {
    "en": "Mr Mrs Ms Dr Prof St Gen Sen Rep Gov Capt Lt Col Sgt Rev Hon Mt Messrs",
    "es": "Sr Sra Srta Dr Dra Prof Profa D Dña Ud Uds Sto Sta Ing Lic EE",
    "fr": "M MM Mme Mmes Mlle Mlles Dr Pr Prof St Ste Me Mgr",
    "de": "Dr Prof Hr Fr Herr Frl Dipl Ing St Hl",
    "ru": "им ул гл акад проф доц гр тов",
    "hi": "डॉ श्री प्रो पं",
    "ar": "د أ م ا",
}
NUMBERED = {
    "en": "No Nos Fig Figs approx Vol Ch Sec Art p pp vol ca Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec",
    "es": "núm nº n.º pág págs aprox art cap fig vol No ene feb abr ago sept oct nov dic",
    "fr": "n no env chap fig art vol p pp av janv févr avr juil sept oct nov déc",
    "de": "Nr Abb Bd S ca Kap Art Abs Tab vgl Str Jan Feb Apr Aug Sept Okt Nov Dez",
    "ru": "стр рис № гл п ст ок янв февр апр авг сент окт нояб дек",
    "hi": "सं क्र पृ",
    "ar": "ص رقم",
}
INNER = {
    "en": "e.g i.e vs cf viz al",
    "es": "p.ej p p.e vs cf EE.UU",
    "fr": "p.ex p c.-à-d cf",
    "de": "z.B z d.h d u.a u o.ä bzw ggf i.d.R v.a vgl usw",
    "ru": "т.е т т.к т.д т.п",
}
# Forms of a company, one of which may follow another, and weekdays before a month.
COMPANIES = "Inc Corp Ltd Co Bros Assn Dept Univ LLC GmbH AG S.A S.L"
WEEKDAYS, MONTH_NAMES = "Mon Tue Tues Wed Thu Thurs Fri Sat Sun", "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
# Months, after which a German ordinal is no end.
MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"


def _words(text: str) -> str:
    """Alternatives for a list of abbreviations; a point inside may be followed by a space."""
    return "|".join(regex.escape(_shadow_letters(w)).replace(r"\.", r"\.\s?") for w in text.split())


def _shadow_letters(text: str) -> str:
    one, many, looks = tables()
    return "".join(looks.get(one.get(c, c), one.get(c, c)) if c.isalnum() else c for c in text)


NOT_WORD = r"(?<![\p{L}\p{M}\p{Nd}])"
# Tables of the cascade, in order.
INSIDE = [
    Rule(False, r".", r"[ \t]*[,;:،、，；：·]"),
    Rule(False, r".", r"[^\S\n]+[^\p{L}\p{N}\n]+(?:\n|\Z)"),
    Rule(False, r"\.", r"\p{Nd}"),
    Rule(False, r".", r"[^\S\n]*\s?[—–-]\s+\p{Ll}"),
    Rule(False, r".", r"\s*\p{Ll}"),
    Rule(False, r"(?:…|\.\.\.?)", r"\s*" + CASELESS),
    Rule(False, r".", rf"[{TERMINAL}]"),
]
SPEECH = [
    Rule(False, r"[" + TERMINAL + r"][\"”’»」』)]+", r"\s*(?:と|って)"),
    Rule(False, r"[" + TERMINAL + r"]\s?[\"”’»」』]+", r"\s*" + CASELESS, quote=True),
]
INITIALS = [Rule(False, NOT_WORD + r"\p{Lu}\.", r"\s*\p{Lu}[\p{L}.'’-]")]
END = [
    Rule(True, rf"[。！？｡][{CLOSE}“]*", r""),
    Rule(True, rf"{CASELESS}[!?…]+[{CLOSE}]*", rf"(?:\s|[{OPEN}]|{CASELESS})"),
    Rule(True, rf"[{TERMINAL}][{CLOSE}“]*", r"\s"),
    Rule(True, rf"[{TERMINAL}]\s[»”]", r"\s"),
]
THAI = [
    Rule(False, r"\p{N}", r"\s"),
    Rule(False, r".", r"\s+\p{N}"),
    Rule(False, r"\n", r""),
    Rule(True, r"[\p{Thai}\"”’)]", r"[^\S\n]+[\p{Thai}“\"‘(]"),
]


@functools.cache
def cascade(lang: str) -> tuple:
    """Compiled rules of a language; an unknown one gets the abbreviations of all."""
    langs = [lang] if lang in {*TITLES, "zh", "ja", "th"} else [*TITLES]
    pick = lambda t: " ".join(t[x] for x in langs if x in t)
    table = list(INSIDE)
    if lang == "de" or len(langs) > 1:
        table.append(Rule(False, NOT_WORD + r"\p{Nd}{1,2}\.", rf"\s*(?:{MONTHS})"))
    for words, after in ((pick(TITLES), r"\s*\p{L}"), (pick(NUMBERED), r"\s*[\p{Nd}\p{Lu}]?\p{Nd}"), (pick(INNER), r"\s*[\p{L}\p{Nd}]")):
        if words:
            table.append(Rule(False, NOT_WORD + rf"(?:{_words(words)})\.", after))
    if lang == "en" or len(langs) > 1:
        table.append(Rule(False, NOT_WORD + rf"(?:{_words(COMPANIES)})\.", rf"\s*(?:{_words(COMPANIES)})(?![\p{{L}}])"))
        table.append(Rule(False, NOT_WORD + rf"(?:{_words(WEEKDAYS)})\.", rf"\s*(?:\p{{Nd}}|(?:{MONTH_NAMES})\p{{Ll}}*[ .]\s*\p{{Nd}})"))
    table += INITIALS + SPEECH + (THAI if lang == "th" else []) + END
    return tuple((r.breaks, r.quote, regex.compile(f"(?<={r.before})(?={r.after})")) for r in table)


_CANDIDATE = regex.compile(rf"[{TERMINAL}]+(?:[{CLOSE}]|[^\S\n]»|(?<=„[^„“”\n]*)“)*")
_THAI_CANDIDATE = regex.compile(rf"[{TERMINAL}]+[{CLOSE}]*|(?=(?<=\S)[^\S\n]+\S)")
_ODD = re.compile(f"[{re.escape(INVISIBLE)}̀-ͯ٠-٩０-９Ａ-Ｚａ-ｚͰ-ϿЀ-ӿ]|[ﬀ-ﬆ]")
_SKIP = frozenset(INVISIBLE)


@functools.cache
def _letter_map() -> dict[int, str]:
    one, _, looks = tables()
    out = {ord(c): looks.get(to, to) for c, to in one.items() if len(to) == 1 and to.isalnum()}
    return out | {ord(c): to for c, to in looks.items()}


def shadow(text: str) -> tuple[str, list[int] | None]:
    """The text that rules read, and the stored offset of each of its characters (None: the same)."""
    if text.isascii() or not _ODD.search(text):
        return text, None
    if not any(c in _SKIP or "̀" <= c <= "ͯ" for c in text):
        return text.translate(_letter_map()), None
    out: list[str] = []
    at: list[int] = []
    letters = _letter_map()
    for i, c in enumerate(text):
        if c in _SKIP:
            continue
        if "̀" <= c <= "ͯ" and out:
            both = unicodedata.normalize("NFC", out[-1] + c)
            if len(both) == 1:
                out[-1] = both
                continue
        out.append(letters.get(ord(c), c))
        at.append(i)
    return "".join(out), at


def guess_language(text: str) -> str:
    """By script, for texts whose language is not known."""
    for lang, script in (("th", "Thai"), ("ja", "Hiragana"), ("zh", "Han"), ("hi", "Devanagari"), ("ar", "Arabic"), ("ru", "Cyrillic")):
        if len(regex.findall(rf"\p{{{script}}}", text)) * 4 > len(text):
            return lang
    return ""


def sentence_spans(text: str, lang: str | None = None) -> list[tuple[int, int]]:
    """Half-open spans of the sentences of one text."""
    lang = lang or guess_language(text)
    s, at = shadow(text)
    rules = cascade(lang)
    cuts: list[int] = []
    start = 0
    blocks = [(m.start(), m.end()) for m in BLANK.finditer(s)]
    for lo, hi in zip([0, *(b for _, b in blocks)], [*(a for a, _ in blocks), len(s)], strict=True):
        while lo < hi and s[lo].isspace():
            lo += 1
        start = lo
        cuts.append(lo)
        for m in (_THAI_CANDIDATE if lang == "th" else _CANDIDATE).finditer(s, lo, hi):
            p = m.end()
            if p >= hi or p <= start:
                continue
            for breaks, quote, rule in rules:
                if quote and s[start] not in OPEN:
                    continue
                if rule.match(s, p):
                    if breaks:
                        while p < hi and s[p].isspace():
                            p += 1
                        start = p
                        cuts.append(p)
                    break
        cuts.append(hi)
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a >= b:
            continue
        if at is not None:
            a, b = at[a], at[b] if b < len(at) else len(text)
        piece = text[a:b]
        a, b = a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())
        if a < b and not all(c in _SKIP for c in text[a:b]):
            out.append((a, b))
    return out


def _language(meta: str | None) -> str | None:
    try:
        lang = json.loads(meta).get("lang") if meta else None
        return lang if isinstance(lang, str) else None
    except (ValueError, AttributeError):
        return None


def split_sentences(df: DataFrame, key: str = "id", column: str = "text", meta: str | None = "meta", lang: str | None = None) -> DataFrame:
    """(key, sentence_index, char_start, char_end, text): one row per sentence of each row; no shuffle.

    The language comes from the column ``lang``, or from ``lang`` in the JSON column ``meta``, else from the script.
    Null and blank texts have no sentences.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, t, m in zip(part["key"], part["text"], part["hint"], strict=True):
                spans = sentence_spans(t, m if lang else _language(m))
                rows += [(k, i, a, b, t[a:b]) for i, (a, b) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=[key, "sentence_index", "char_start", "char_end", "text"])

    hint = F.col(lang) if lang else F.col(meta) if meta else F.lit(None).cast("string")
    texts = df.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).alias("text"), hint.alias("hint"))
    kind = df.schema[key].dataType.simpleString()
    return texts.mapInPandas(run, f"`{key}` {kind}, sentence_index int, char_start int, char_end int, text string")


def sentences_found(essays: DataFrame) -> DataFrame:
    """(id, char_start, char_end), each once; an essay delivered twice is one essay."""
    return split_sentences(essays.where("id IS NOT NULL")).select("id", "char_start", "char_end").distinct()
