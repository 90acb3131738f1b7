"""Paged and remote row sources as Spark data sources.

``register(spark)`` makes the formats known; ``spark.read.format(name)`` then reads them, one partition per page, so pages
are fetched by executors and a lost executor's pages are fetched again. A page comes from a function named by the option
``fetch`` as ``module:function``, called with the options and the page's number; it returns a list of dicts. An unknown
format name raises when it is read (S10).
"""

from __future__ import annotations

import importlib
import json
import os
import re
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds waited before the second to the fifth attempt.
WAITS = (2, 4, 6, 8)
PAGE = 100


def with_retry(call, waits: tuple[float, ...] = WAITS, sleep=time.sleep):
    """``call()``, again after each wait if it raises OSError; the last error is raised."""
    for wait in (*waits, None):
        try:
            return call()
        except OSError:
            if wait is None:
                raise
            sleep(wait)


def json_page(options: dict, page: int) -> list[dict]:
    """Rows of ``<path>/<page>.json``, an array of objects; no such file is an empty page."""
    path = os.path.join(options["path"], f"{page}.json")
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def parquet_page(options: dict, page: int) -> list[dict]:
    """Rows of a Parquet file or of a folder of them, ``page_size`` at a time, in the order of the files' names; only
    ``columns`` are read. Of a row group only the batches up to the page's last row are decoded."""
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    size, columns = int(options.get("page_size", PAGE)), options["columns"].split(",")
    first, out = 0, []
    for path in sorted(ds.dataset(options["path"].removeprefix("file://"), format="parquet").files):
        with pq.ParquetFile(path) as rows:
            for g in range(rows.num_row_groups):
                n = rows.metadata.row_group(g).num_rows
                lo, hi = max(0, page * size - first), min(n, (page + 1) * size - first)
                first += n
                if lo >= hi:
                    continue
                at = 0
                for batch in rows.iter_batches(min(size, 4096), row_groups=[g], columns=columns):
                    if at + batch.num_rows > lo:
                        out += batch.slice(max(0, lo - at), hi - max(lo, at)).to_pylist()
                    at += batch.num_rows
                    if at >= hi:
                        break
        if first >= (page + 1) * size:
            break
    return out


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedRows(DataSource):
    """Options: fetch, pages (how many), schema by ``.schema(...)``, stride (one page in so many), and what ``fetch`` reads."""

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def reader(self, schema):
        return _PagedReader(dict(self.options), [f.name for f in schema.fields])


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = options, names

    def partitions(self) -> list[InputPartition]:
        return [_Page(p) for p in range(0, int(self.options["pages"]), int(self.options.get("stride", 1)))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        module, _, function = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), function)
        for row in with_retry(lambda: fetch(self.options, partition.number)):
            yield tuple(row.get(n) for n in self.names)


class HtmlPosts(PagedRows):
    """Pages of posts {id, date, html}; their text is that of the <p> elements."""

    @classmethod
    def name(cls) -> str:
        return "html_posts"

    def schema(self) -> str:
        return "id string, date string, text string"

    def reader(self, schema):
        return _HtmlReader(dict(self.options), ["id", "date", "html"])


class _HtmlReader(_PagedReader):
    def read(self, partition: _Page) -> Iterator[tuple]:
        for key, date, html in super().read(partition):
            yield key, date, paragraphs_of(html or "")


def paragraphs_of(html: str) -> str:
    """Text of the <p> elements, one to a paragraph, without tags and with entities resolved."""
    from html import unescape

    texts = (unescape(re.sub(r"<[^>]*>", "", p)).strip() for p in re.findall(r"(?is)<p\b[^>]*>(.*?)</p\s*>", html))
    return "\n\n".join(t for t in texts if t)


SOURCES = (PagedRows, HtmlPosts)


def register(spark: SparkSession) -> None:
    """Makes the formats known by name."""
    for s in SOURCES:
        spark.dataSource.register(s)


def posts_before(spark: SparkSession, options: dict, last_date: str = "2022-11-30", least_words: int = 150) -> DataFrame:
    """Posts up to a date with enough words."""
    register(spark)
    x = spark.read.format("html_posts").options(**options).load()
    return x.where(F.substring("date", 1, 10) <= last_date).withColumn("n_words", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).where(F.col("n_words") >= least_words)


def flagged_rows(spark: SparkSession, options: dict, schema: str, text: str, flag: str | None = None, flags: tuple[str, ...] = ("Yes", "No"), least_words: int = 100, target: int | None = None) -> DataFrame:
    """Rows of all pages with enough words and a known flag, each text once (the smallest row of it), at most ``target``."""
    register(spark)
    x = spark.read.format("paged_rows").schema(schema).options(**options).load().where(F.col(text).isNotNull())
    if flag:
        x = x.where(F.col(flag).isin(*flags))
    x = x.withColumn("sha256", F.sha2(F.col(text), 256)).where(F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")) >= least_words)
    once = x.groupBy("sha256").agg(F.min(F.struct(*(c for c in x.columns if c != "sha256"))).alias("r")).select("r.*", "sha256")
    return once.orderBy(once.columns[0]).limit(target) if target is not None else once
