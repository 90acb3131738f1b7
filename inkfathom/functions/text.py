"""Scalar text expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfathom.functions import lexicons as L

WORD = "[A-Za-zÀ-ɏ']+"


def canonical(t: Column) -> Column:
    """Line ends to LF, typography to one form, runs of blanks and blank lines shortened, ends trimmed."""
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.translate(t, "".join(L.TYPOGRAPHY_ONE) + L.ZERO_WIDTH, "".join(L.TYPOGRAPHY_ONE.values()))
    t = F.regexp_replace(t, f"[{L.TYPOGRAPHY_DASHES}]", " - ")
    t = F.replace(t, F.lit(L.ELLIPSIS), F.lit("..."))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def flatten(t: Column) -> Column:
    """Each line break with the white space around it becomes one space."""
    return F.regexp_replace(F.regexp_replace(t, r"\s*\n+\s*", " "), r"^\s+|\s+$", "")


def words(t: Column) -> Column:
    """Words in lower case, apostrophes kept."""
    return F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0))


def count_words(t: Column) -> Column:
    """Words by white space; 0 for an empty text."""
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+"))).cast("bigint")


def slug(t: Column) -> Column:
    """Lower case, other characters to single dashes, at most 40 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)


def hash_half(t: Column, salt: str) -> Column:
    """0 or 1 from the first 32 bits of a salted SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt + ":"), t), 256), 1, 8), 16, 10).cast("bigint") % 2


def ratio_sum(xs: Column, n: Column) -> Column:
    return F.try_divide(xs.cast("double"), n)
