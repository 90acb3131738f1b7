"""Word processor and plain text files as rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Text of a .docx file: paragraphs by line, tabs and breaks kept; deleted text and field codes are skipped."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = []
    for p in root.iter(_W + "p"):
        out: list[str] = []

        def walk(e: ElementTree.Element, out: list[str] = out) -> None:
            if e.tag in (_W + "del", _W + "instrText", _W + "delText"):
                return
            if e.tag == _W + "t":
                out.append(e.text or "")
            elif e.tag in (_W + "tab", _W + "br", _W + "cr"):
                out.append("\t" if e.tag == _W + "tab" else "\n")
            else:
                for c in e:
                    if c.tag != _W + "p":
                        walk(c)

        for c in p:
            walk(c)
        lines.append("".join(out))
    return "\n".join(lines).strip()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, problem) of .txt and .docx files; PDF and other kinds, and files that cannot be read, have a problem and no
    text, and do not end the job."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, data in zip(part["path"], part["content"], strict=True):
                kind = name.rsplit(".", 1)[-1].lower()
                try:
                    text = docx_text(data) if kind == "docx" else data.decode("utf-8-sig") if kind == "txt" else None
                    rows.append((name, text, None if text is not None else "pdf is not read" if kind == "pdf" else "unknown kind"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, UnicodeDecodeError) as e:
                    rows.append((name, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "text", "problem"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, problem string")
