"""Spreadsheet workbooks (.xlsx, .xlsm), each read by the task that holds it."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprofile.sources.delimited import clean_names, infer_types

# XML namespaces of the workbook format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"

# Built-in number formats that show a date or time.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}

BATCH_ROWS = 20_000


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of every sheet, in order."""
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in links.iter(f"{_PACKAGE}Relationship")}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    out = []
    for s in root.iter(f"{_MAIN}sheet"):
        part = target[s.get(f"{_REL}id")]
        out.append((s.get("name"), part.lstrip("/") if part.startswith("/") else f"xl/{part}"))
    return out


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return [_text(item) for item in root.iter(f"{_MAIN}si")]


def _text(item: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in item.iter(f"{_MAIN}t"))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Positions of the cell styles that show a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dates = set(_DATE_FORMATS)
    for f in root.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", ""))
        if re.search(r"[ymdhs]", code, re.IGNORECASE):
            dates.add(int(f.get("numFmtId")))
    styles = root.find(f"{_MAIN}cellXfs")
    cells = [] if styles is None else list(styles)
    return {k for k, x in enumerate(cells) if int(x.get("numFmtId", 0)) in dates}


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(ch) - ord("A") + 1
    return n - 1


def _rows(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells as text) of one sheet, parsed as a stream."""
    strings, dates = _shared_strings(book), _date_styles(book)
    with book.open(part) as stream:
        number = 0
        for _, row in ElementTree.iterparse(stream):
            if row.tag != f"{_MAIN}row":
                continue
            number = int(row.get("r", number + 1))
            cells: list[str | None] = []
            for c in row.iter(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = _cell(c, strings, dates)
            yield number, cells
            row.clear()


def _cell(c: ElementTree.Element, strings: list[str], dates: set[int]) -> str | None:
    kind, v = c.get("t", "n"), c.findtext(f"{_MAIN}v")
    if kind == "inlineStr":
        return _text(c)
    if v is None:
        return None
    if kind == "s":
        return strings[int(v)]
    if kind == "b":
        return "True" if v == "1" else "False"
    if kind == "e":
        return None
    if kind == "n" and int(c.get("s", 0)) in dates:
        moment = datetime(1899, 12, 30) + timedelta(days=float(v))
        return moment.isoformat(sep=" ", timespec="seconds")
    return v


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet_index, sheet_name) of every workbook under a path or pattern."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    rows += [(name, k, s) for k, (s, _) in enumerate(_sheets(book))]
            yield pd.DataFrame(rows, columns=["path", "sheet_index", "sheet_name"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(look, "path string, sheet_index int, sheet_name string")


def sheet_rows(spark: SparkSession, path: str, sheet: str | int | None = None) -> DataFrame:
    """(path, row, cells) of one sheet of every workbook under a path; the first by default."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    sheets = _sheets(book)
                    wanted = [
                        part for k, (s, part) in enumerate(sheets) if s == sheet or k == (sheet or 0)
                    ]
                    if not wanted:
                        raise ValueError(f"Sheet {sheet!r} not found in {name}")
                    rows: list[tuple] = []
                    for number, cells in _rows(book, wanted[0]):
                        rows.append((name, number, cells))
                        if len(rows) == BATCH_ROWS:
                            yield pd.DataFrame(rows, columns=["path", "row", "cells"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, row int, cells array<string>")


def read_workbook(
    spark: SparkSession,
    path: str,
    sheet: str | int | None = None,
    parse_dates: list[str] | None = None,
) -> DataFrame:
    """One sheet of a workbook as a typed table; its first row is the header."""
    rows = sheet_rows(spark, path, sheet)
    first = rows.agg(F.min("row")).first()[0]
    if first is None:
        return spark.createDataFrame([], "")
    header = rows.where(F.col("row") == first).first()["cells"]
    names = clean_names([h or "" for h in header])
    body = rows.where((F.col("row") > first) & F.exists("cells", lambda c: c.isNotNull()))
    raw = body.select(*[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)])
    return infer_types(raw, parse_dates or [])
