"""Logical column types and the casts that go with them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text longer than this is grouped by its SHA-256, so a shuffle never moves whole
# documents.  A folded key is one byte longer than any unfolded one.
FOLD_BYTES = 64


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def numeric_columns(df: DataFrame, with_bool: bool = False) -> list[str]:
    """Numeric columns; booleans count only in drift, target and contracts."""
    return [
        f.name
        for f in df.schema.fields
        if is_number(f.dataType) or (with_bool and isinstance(f.dataType, T.BooleanType))
    ]


def categorical_columns(df: DataFrame, with_bool: bool = True) -> list[str]:
    numeric = set(numeric_columns(df, with_bool=not with_bool))
    return [c for c in df.columns if c not in numeric]


def logical_type(dtype: T.DataType) -> str:
    """Contract type: numeric (with booleans), datetime or categorical."""
    if is_datetime(dtype):
        return "datetime"
    if is_number(dtype) or isinstance(dtype, T.BooleanType):
        return "numeric"
    return "categorical"


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def present(df: DataFrame, name: str) -> Column:
    return value(df, name).isNotNull()


def as_double(df: DataFrame, name: str) -> Column:
    return value(df, name).cast("double")


def as_text(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    c = value(df, name)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if is_nested(dtype):
        return F.to_json(c)
    return c.cast("string")


def fold(text: Column) -> Column:
    """Text as a bounded grouping key: itself, or '#' and its SHA-256 when long."""
    return F.when(
        F.octet_length(text) > FOLD_BYTES, F.concat(F.lit("#"), F.sha2(text, 256))
    ).otherwise(text)


def text_key(df: DataFrame, name: str) -> Column:
    """Grouping key of a column read as text; only long text needs folding."""
    dtype = df.schema[name].dataType
    text = as_text(df, name)
    if is_text(dtype) or is_nested(dtype) or isinstance(dtype, T.BinaryType):
        return fold(text)
    return text


def group_key(df: DataFrame, name: str) -> Column:
    """Grouping key that keeps equal values equal and different values different."""
    dtype = df.schema[name].dataType
    if is_text(dtype) or is_nested(dtype) or isinstance(dtype, T.BinaryType):
        return text_key(df, name)
    return value(df, name)


def chunks(items: list, size: int) -> Iterable[list]:
    for start in range(0, len(items), size):
        yield items[start : start + size]


# One aggregate holds at most this many expressions: beyond a hundred buffer fields Spark gives up
# whole-stage code generation.  Wider work takes further scans, each reading only its own columns.
MAX_EXPRESSIONS = 90
# Scans of one table that run side by side.
MAX_SCANS = 4


def aggregate_once(df: DataFrame, exprs: dict[str, Column], at_once: int = MAX_EXPRESSIONS) -> dict:
    """Evaluate named global aggregates and return them as one dict.

    Each chunk is one scan with map-side aggregation and a single row per task in the shuffle;
    Parquet reads only the columns its chunk names.  Chunks run side by side.
    """

    def run(part: list) -> dict:
        row = df.agg(*[e.alias(str(i)) for i, (_, e) in enumerate(part)]).first()
        return {name: row[i] for i, (name, _) in enumerate(part)}

    parts = list(chunks(list(exprs.items()), at_once))
    out: dict = {}
    with ThreadPoolExecutor(MAX_SCANS) as pool:
        for got in pool.map(run, parts):
            out |= got
    return out


def together(*work: Callable[[], object]) -> list:
    """Run independent Spark jobs at the same time; Spark shares its executors among them."""
    with ThreadPoolExecutor(max(1, len(work))) as pool:
        return [f.result() for f in [pool.submit(w) for w in work]]


def small_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A result of at most columns-squared rows as a DataFrame; NaN becomes NULL."""

    def plain(v):
        if isinstance(v, float) and math.isnan(v):
            return None
        if hasattr(v, "item"):
            return plain(v.item())
        return v

    return spark.createDataFrame([tuple(plain(v) for v in r) for r in rows], schema)
