"""File sources and sinks: JSON lines, JSON arrays, text directories, CSV, HTML archives and chat rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.functions import text as X

DOCUMENT = "id string, source_id string, text string, authorship string, role string, n_words bigint, sha256 string, meta string"


def read_jsonl(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """One record per line; blank lines are skipped, malformed ones raise."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, UTF-8."""
    df.write.mode("overwrite").json(path)


def read_json_array(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A file with one JSON array of objects with ``text``; empty texts are dropped, ids number the rest of the file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<map<string,string>>")).alias("i", "m"))
    rest = F.to_json(F.map_filter("m", lambda k, _: k != "text"))
    return rows.select(F.format_string("%s:%04d", F.lit(source), F.col("i")).alias("id"), F.lit(source).alias("source_id"), F.col("m")["text"].alias("text"), rest.alias("meta")).where("trim(text) <> ''")


def read_text_files(spark: SparkSession, path: str, least_words: int = 50) -> DataFrame:
    """One document per file."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return t.withColumn("n_words", X.count_words(F.col("text"))).where(F.col("n_words") >= least_words)


def read_csv_documents(spark: SparkSession, path: str, text: str, score: str, least_words: int = 100) -> DataFrame:
    """Quoted multi-line CSV; the score becomes a number or NULL."""
    d = spark.read.csv(path, header=True, multiLine=True, escape='"')
    d = d.withColumn("proficiency", F.expr(f"try_cast(`{score}` AS double)")).withColumn("n_words", X.count_words(F.col(text)))
    return d.where(F.col("n_words") >= least_words)


class _Paragraphs(HTMLParser):
    """Text of the paragraphs under each heading of one level, and of the first smaller heading."""

    def __init__(self, heading: str, place: str | None = None):
        super().__init__()
        self.heading, self.place, self.sections, self.inside = heading, place, [], None

    def handle_starttag(self, tag, attrs):
        if tag == self.heading:
            self.sections.append(["", [], None])
            self.inside = "title"
        elif tag == self.place and self.sections and self.sections[-1][2] is None:
            self.sections[-1][2] = ""
            self.inside = "place"
        elif tag == "p" and self.sections:
            self.sections[-1][1].append("")
            self.inside = "p"

    def handle_endtag(self, tag):
        if tag in ("p", self.heading, self.place):
            self.inside = None

    def handle_data(self, data):
        if self.inside == "title":
            self.sections[-1][0] += data
        elif self.inside == "place":
            self.sections[-1][2] += data
        elif self.inside == "p":
            self.sections[-1][1][-1] += data


def html_sections(pages: DataFrame, html: str = "html", heading: str = "h3", least: int = 150, most: int = 1500, place: str | None = None) -> DataFrame:
    """(title, text) of the sections of HTML pages, paragraphs joined by blank lines, by number of words; with
    ``place``, the text of a section's first heading of that level is a third column of this name."""
    names = ["title", "text", *(["place"] if place else [])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for page in part[html].dropna():
                p = _Paragraphs(heading, place)
                p.feed(page)
                rows += [(t.strip(), "\n\n".join(x.strip() for x in ps if x.strip()), w.strip() if w else None) for t, ps, w in p.sections]
            yield pd.DataFrame([r[: len(names)] for r in rows if least <= len(r[1].split()) <= most], columns=names)

    return pages.select(html).mapInPandas(run, ", ".join(f"{n} string" for n in names))


def chat_rows(df: DataFrame, system: str, user: str, assistant: str) -> DataFrame:
    """One JSON chat per row: system, user and assistant messages."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return df.select(F.to_json(F.struct(F.array(message("system", system), message("user", user), message("assistant", assistant)).alias("messages"))).alias("value"))


def write_chat(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)
