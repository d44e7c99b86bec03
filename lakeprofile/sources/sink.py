"""Writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeprofile.functions.columns import col


def _finite(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda e: _finite(e, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [_finite(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers become NULL, in nested fields too."""
    return df.select(*[_finite(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def write_sections(sections: dict[str, DataFrame], directory: str, fmt: str = "json") -> None:
    """One folder per result section, written by Spark."""
    for name, df in sections.items():
        writer = json_safe(df).write.mode("overwrite")
        if fmt == "json":
            writer = writer.option("ignoreNullFields", False)
        writer.format(fmt).save(f"{directory.rstrip('/')}/{name}")
