"""Delimited text: looking at all lines, reading cells as strings and typing the columns."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeprofile.functions.columns import aggregate_once, col, small_table, together
from lakeprofile.functions.text import NA_TOKENS, parse_date, parses_as_number
from lakeprofile.sources import encodings

# The delimiters looked for.
DELIMITERS = [",", ";", "\t", "|"]

# Byte order marks and the encodings they announce, longest first.
_MARKS = [
    ("EFBBBF", "utf-8-sig"), ("FFFE0000", "utf-32"), ("0000FEFF", "utf-32"), ("FFFE", "utf-16"),
    ("FEFF", "utf-16"),
]

# Names of these encodings as Spark's reader knows them.
_SPARK_NAMES = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "utf-16": "UTF-16", "utf-32": "UTF-32"}

# The others that can be found out are read as ISO Latin, a character for each byte, and corrected.
_BYTES = "ISO-8859-1"
_CORRECTED = {c.name for c in encodings.CANDIDATES}


def _replaced(encoding: str) -> tuple[str, str]:
    """The characters of ISO Latin that stand for others in an encoding of single bytes, and those."""
    pairs = {chr(b): bytes([b]).decode(encoding, errors="ignore") for b in range(0x80, 0x100)}
    wrong = "".join(c for c, right in pairs.items() if right and right != c)
    return wrong, "".join(pairs[c] for c in wrong)


def _corrected(raw: DataFrame, encoding: str) -> DataFrame:
    """Cells that were read a character for each byte, in the encoding that they have."""
    if encoding not in encodings.WIDE:
        wrong, right = _replaced(encoding)
        return raw.select(*[F.translate(c, wrong, right).alias(c) for c in raw.columns])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [
                [v if v is None else v.encode("latin-1").decode(encoding, errors="replace") for v in c.to_pylist()]
                for c in batch.columns
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cells], names)

    names = raw.columns
    return raw.mapInArrow(decoded, raw.schema)


_BAD = "__bad_record"


def cells_in(line: Column, delimiter: str) -> Column:
    """How many cells a line has; delimiters between quotes are text."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1


def _open_quote(line: Column) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1


def delimiter_counts(lines: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys..., delimiter, cells, lines): how many lines, blank ones apart, have how many cells."""
    each = F.array(*[
        F.struct(F.lit(d).alias("delimiter"), cells_in(F.col("value"), d).alias("cells"))
        for d in DELIMITERS
    ])
    counted = lines.where(F.trim("value") != "").select(*keys, F.explode(each).alias("e"))
    return counted.select(*keys, "e.*").groupBy(*keys, "delimiter", "cells").agg(
        F.count(F.lit(1)).alias("lines")
    )


def best_delimiter(lines: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys..., delimiter): the candidate that splits most lines into one number of cells.

    All lines count.  Of equals the one with more cells, then the first of DELIMITERS; comma where
    no candidate occurs.
    """
    counts = delimiter_counts(lines, keys)
    place = F.array_position(F.array(*map(F.lit, DELIMITERS)), F.col("delimiter"))
    usual = F.max(F.struct("lines", "cells")).alias("usual")
    by = counts.groupBy(*keys, "delimiter").agg(usual)
    split = by.where("usual.cells > 1").groupBy(*keys).agg(
        F.max(F.struct("usual.lines", "usual.cells", (-place).alias("place"), "delimiter")).alias("best")
    )
    return split.select(*keys, F.col("best.delimiter").alias("delimiter"))


def sniff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, encoding, delimiter, open_quotes) of each file under a path, from all its lines.

    A byte order mark names the encoding; otherwise text is UTF-8 if every line is, else what all
    lines that are not make likeliest (see `encodings`).  ``open_quotes`` counts lines with an odd
    number of quotes, which hold a line break.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    raw = F.col("value").cast("binary")
    marks = [
        F.when(F.startswith(raw, F.unhex(F.lit(mark))), F.lit(len(_MARKS) - k))
        for k, (mark, _) in enumerate(_MARKS)
    ]
    facts = lines.groupBy("path").agg(
        F.max(F.coalesce(*marks)).alias("mark"),
        F.count_if(~F.is_valid_utf8("value")).alias("broken"),
        F.count_if(_open_quote(F.col("value"))).alias("open_quotes"),
    )
    found = facts.join(best_delimiter(lines, ["path"]), "path", "left").collect()  # one row per file
    # Only files that are neither marked nor UTF-8 are read again.
    unknown = [r["path"] for r in found if r["mark"] is None and r["broken"]]
    likely = {}
    if unknown:
        again = spark.read.text(unknown).select(F.col("_metadata.file_path").alias("path"), "value")
        strange = again.where(~F.is_valid_utf8("value")).select("path", F.col("value").cast("binary").alias("value"))
        likely = {r["path"]: r["encoding"] for r in encodings.best_encodings(strange).collect()}

    def encoding(r) -> str:
        if r["mark"] is not None:
            return _MARKS[len(_MARKS) - r["mark"]][1]
        return likely.get(r["path"], "utf-8")

    rows = [(r["path"], encoding(r), r["delimiter"] or ",", r["open_quotes"]) for r in found]
    return small_table(spark, rows, "path string, encoding string, delimiter string, open_quotes bigint")


def read_delimited(
    spark: SparkSession,
    path: str,
    parse_dates: list[str] | None = None,
    encoding: str | None = None,
    delimiter: str | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """Delimited files with a header as a typed table: a file, a folder or a pattern, plain or gzip.

    What is not given is found out from all lines of all files.  Files may differ in encoding, not
    in delimiter or header.  A record with more cells than the header raises; `bad_records` shows
    such records.  A file whose encoding stays undecided raises, and so does a decision that does not
    allow the delimiter; then, or for encodings that are not looked for, name it.
    """
    parts, names = _raw_parts(spark, path, encoding, delimiter, multiline)
    bad, typed = together(
        lambda: _long_records(parts, names).limit(1).count(),
        lambda: infer_types(_joined(parts, names), parse_dates or []),
    )
    if bad:
        raise ValueError(f"{path} has records of more than {len(names)} cells, see bad_records")
    return typed


def bad_records(spark: SparkSession, path: str, **options) -> DataFrame:
    """(record): the records of more cells than the header has, as they were written."""
    return _long_records(*_raw_parts(spark, path, **options))


def _raw_parts(
    spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None,
    multiline: bool | None = None,
) -> tuple[list[tuple[DataFrame, str]], list[str]]:
    """Tables of strings with their delimiter, one for each encoding, and the column names."""
    found = sniff(spark, path).collect()  # one row per file
    delimiters = {delimiter} if delimiter else {r["delimiter"] for r in found} or {","}
    if len(delimiters) > 1:
        raise ValueError(f"the files under {path} differ in delimiter: {sorted(delimiters)}")
    mark = delimiters.pop()
    if encoding and codecs.lookup(encoding).name in _CORRECTED:
        encoding = codecs.lookup(encoding).name
    by_encoding: dict[str, list] = {}
    for r in found:
        by_encoding.setdefault(encoding or r["encoding"], []).append(r)
    parts, names = [], None
    for kind, files in by_encoding.items():
        paths = path if len(by_encoding) == 1 else [r["path"] for r in files]
        if kind == encodings.UNDECIDED:
            raise ValueError(f"name the encoding of {sorted(r['path'] for r in files)[:5]}")
        if kind in encodings.WIDE and mark == "|":
            raise ValueError(f"{kind} has bytes like | inside its characters, convert {path} first")
        name = _BYTES if kind in _CORRECTED else _SPARK_NAMES.get(kind, kind)
        wide = name in ("UTF-16", "UTF-32")  # Spark splits lines by single bytes
        whole = wide or (any(r["open_quotes"] for r in files) if multiline is None else multiline)
        options = {"sep": mark, "encoding": name, "multiLine": whole, "quote": '"', "escape": '"'}
        head = spark.read.csv(paths, header=False, **options).first()
        if head is None:
            continue
        header = [c if c is not None else "" for c in head]
        if kind in encodings.WIDE:
            header = [c.encode("latin-1").decode(kind, errors="replace") for c in header]
        elif kind in _CORRECTED:
            header = [c.translate(str.maketrans(*_replaced(kind))) for c in header]
        header = clean_names(header)
        if names is not None and header != names:
            raise ValueError(f"the files under {path} differ in header")
        names = header
        fields = [T.StructField(f"c{k}", T.StringType()) for k in range(len(names))]
        schema = T.StructType([*fields, T.StructField(_BAD, T.StringType())])
        # Without pruning, so that records of the wrong length are noticed whatever is read.
        raw = spark.read.options(**options, columnPruning=False).csv(
            paths, schema=schema, header=True, mode="PERMISSIVE", enforceSchema=True,
            columnNameOfCorruptRecord=_BAD,
        )
        if kind in _CORRECTED:
            raw = _corrected(raw, kind)
        parts.append((raw, mark))
    return parts, names or []


def _joined(parts: list[tuple[DataFrame, str]], names: list[str]) -> DataFrame:
    if not parts:
        raise ValueError("there is no header")
    out = parts[0][0]
    for raw, _ in parts[1:]:
        out = out.unionByName(raw)
    return out.drop(_BAD).toDF(*names)


def _long_records(parts: list[tuple[DataFrame, str]], names: list[str]) -> DataFrame:
    out = None
    for raw, delimiter in parts:
        long = F.col(_BAD).isNotNull() & (cells_in(F.col(_BAD), delimiter) > len(names))
        # Bad records cannot be asked for alone.
        asked = F.coalesce(F.length("c0"), F.lit(0)) >= 0
        part = raw.where(long & asked).select(F.col(_BAD).alias("record"))
        out = part if out is None else out.unionAll(part)
    if out is None:
        raise ValueError("there is no header")
    return out


def split_lines(lines: DataFrame, names: list[str], delimiter: str | None = None) -> DataFrame:
    """A table of lines (value) as columns of strings; the delimiter is found from all lines."""
    if delimiter is None:
        found = best_delimiter(lines).first()
        delimiter = found["delimiter"] if found else ","
    fields = ", ".join(f"c{k} string" for k in range(len(names)))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    parsed = lines.select(F.from_csv("value", F.lit(fields), options).alias("v")).select("v.*")
    return parsed.toDF(*clean_names(names))


def long_lines(lines: DataFrame, names: list[str], delimiter: str | None = None) -> DataFrame:
    """(value, cells): the lines with more cells than there are names."""
    if delimiter is None:
        found = best_delimiter(lines).first()
        delimiter = found["delimiter"] if found else ","
    cells = cells_in(F.col("value"), delimiter)
    return lines.select("value", cells.alias("cells")).where(F.col("cells") > len(names))


def clean_names(names: list[str]) -> list[str]:
    """Stripped names; a repeated name gets .1, .2 and so on, an empty one its position."""
    out: list[str] = []
    for k, name in enumerate(names):
        base = str(name).lstrip("﻿").strip() or f"Unnamed: {k}"
        new, n = base, 0
        while new in out:
            n += 1
            new = f"{base}.{n}"
        out.append(new)
    return out


def infer_types(raw: DataFrame, parse_dates: list[str] = ()) -> DataFrame:
    """Columns of strings as whole numbers, doubles, booleans, dates or text.

    One scan tests every cell of every column, so the type never depends on a sample.  As in a
    data frame library, gaps turn whole numbers into doubles and keep booleans as text, and a
    column without any value is a double; but whole numbers that a double cannot hold stay whole,
    as BIGINT or DECIMAL(38,0), and as text beyond that.
    """
    cell = {c: F.when(~col(c).isin(NA_TOKENS), col(c)) for c in raw.columns}
    flags = {}
    for c, v in cell.items():
        number = F.expr(f"try_cast(trim({_name(c)}) as bigint)")
        whole = v.rlike(r"^\s*[+-]?\d+\s*$")
        kind = (
            F.when(whole & number.isNotNull(), WHOLE)
            .when(whole & F.expr(f"try_cast(trim({_name(c)}) as decimal(38,0))").isNotNull(), LARGE)
            .when(whole, TEXT)
            .when(v.isin(TRUTH_VALUES), TRUTH)
            .when(parses_as_number(v), NUMBER)
            .otherwise(TEXT)
        )
        kind = F.when(v.isNotNull(), kind)
        flags |= {
            (c, "gaps"): F.count_if(v.isNull()), (c, "least"): F.min(kind),
            (c, "most"): F.max(kind), (c, "fine"): F.count_if(kind == NUMBER),
            (c, "size"): F.max(F.when(whole, F.abs(number.cast("double")))),
        }
        if c in parse_dates:
            flags[c, "date"] = F.bool_and(F.when(v.isNotNull(), parse_date(v).isNotNull()))
    got = aggregate_once(raw, flags, at_once=60) if flags else {}
    out = []
    for c, v in cell.items():
        gaps, least, most = got[c, "gaps"], got[c, "least"], got[c, "most"]
        if got.get((c, "date")):
            typed = parse_date(v)
        elif least is None:
            typed = F.lit(None).cast("double")
        elif least >= NUMBER:
            exact = (got[c, "size"] or 0) <= EXACT_DOUBLE and most != LARGE and least != LARGE
            if got[c, "fine"] or (gaps and exact):
                typed = F.trim(v).cast("double")
            else:
                typed = F.trim(v).cast("bigint" if least == WHOLE else "decimal(38,0)")
        elif least == most == TRUTH and not gaps:
            typed = F.lower(v) == "true"
        else:
            typed = v
        out.append(typed.alias(c))
    return raw.select(*out)


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


# What one cell can be read as, from the least to the most specific.
TEXT, TRUTH, NUMBER, LARGE, WHOLE = range(5)
# Whole numbers up to here are exact as doubles.
EXACT_DOUBLE = 2.0**53

# Cells read as booleans.
TRUTH_VALUES = ["True", "False", "TRUE", "FALSE", "true", "false"]
