"""Comparison of numeric columns between the classes of another column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from lakeprofile.functions.columns import chunks
from lakeprofile.operators.ranks import BUCKET_ROWS, blocks, bucket_count, numbers, range_limits

# A table of at most this many classes is broadcast.
BROADCAST_CLASSES = 50_000
# Classes times ranges that a block of rows counts in one array.
MOST_COUNTS = 1 << 17
# Ranges with a wanted rank, of all classes and columns, that may pass the driver.
FEW_RANGES = 10_000


@dataclass
class OneWay:
    """One-way layout of one column: classes, rows, and sums of squares."""

    classes: int
    rows: int
    between: float
    within: float

    @property
    def eta_squared(self) -> float:
        total = self.between + self.within
        return min(1.0, max(0.0, self.between / total)) if total > 0 else 0.0

    @property
    def f(self) -> float | None:
        if self.within <= 0 or self.classes < 2 or self.rows <= self.classes:
            return None
        return (self.between / (self.classes - 1)) / (self.within / (self.rows - self.classes))


def one_way(
    df: DataFrame,
    key: Column,
    columns: dict[str, Column],
    min_rows: int = 1,
    centre: dict[str, float] | None = None,
) -> dict[str, OneWay]:
    """Sums of squares of each expression between and within the classes of ``key``.

    Per class only merged moments are shuffled; classes with fewer values are left out.  Values are
    taken from ``centre``, a number near their mean: without it a column of large numbers that lie
    close together would lose its differences when squares are subtracted.
    """
    columns = {c: x - F.lit(centre[c]) if centre else x for c, x in columns.items()}
    out = {}
    for part in chunks(list(columns.items()), 12):
        stats = []
        for k, (_, x) in enumerate(part):
            stats += [F.count(x).alias(f"n{k}"), F.avg(x).alias(f"m{k}"),
                      F.var_pop(x).alias(f"v{k}")]
        classes = df.where(key.isNotNull()).groupBy(key.alias("key")).agg(*stats)
        sums = []
        for k in range(len(part)):
            used = F.col(f"n{k}") >= min_rows
            n, m, v = (F.when(used, F.col(f"{s}{k}")) for s in "nmv")
            sums += [
                F.count_if(used).alias(f"k{k}"), F.sum(n).alias(f"n{k}"),
                F.sum(n * m).alias(f"s{k}"), F.sum(n * v).alias(f"w{k}"),
                F.max(m).alias(f"top{k}"), F.min(m).alias(f"low{k}"),
                F.sum(n * m * m).alias(f"q{k}"),
            ]
        r = classes.agg(*sums).first()
        for k, (name, _) in enumerate(part):
            n = r[f"n{k}"] or 0
            between = 0.0
            if n and r[f"top{k}"] != r[f"low{k}"]:
                between = max(0.0, r[f"q{k}"] - r[f"s{k}"] ** 2 / n)
            out[name] = OneWay(r[f"k{k}"], n, between, r[f"w{k}"] or 0.0)
    return out


def class_cells(
    data: DataFrame, limits: list[np.ndarray], kept: list[np.ndarray] | None = None, values: bool = True
) -> DataFrame:
    """(key, c, b, x, n) from rows (key, columns of doubles): how often a class has a value, in range b of
    its column; without ``values``, how many it has in the range.  Ranges that aren't ``kept`` are left
    out.  A row without any value counts as one cell of column -1, for its class to be known."""
    held = data.sparkSession.sparkContext.broadcast((limits, kept))
    # Nothing is NULL but x: a NULL test inferred for a join would give its branch a scan of its own.
    kinds = [("key", data.schema["key"].dataType), ("c", IntegerType()), ("b", LongType()), ("x", DoubleType()), ("n", LongType())]
    schema = StructType([StructField(name, kind, name == "x") for name, kind in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, kept = held.value
        for block in blocks(batches):
            keys = block.column(0).combine_chunks().dictionary_encode()
            codes, named = keys.indices.to_numpy(), keys.dictionary
            empty = np.ones(len(block), bool)
            for k, own in enumerate(limits):
                x, there = numbers(block.column(k + 1))
                empty &= ~there
                x, code = x[there], codes[there]
                if kept:
                    here = kept[k][np.searchsorted(own, x, "right")]
                    x, code = x[here], code[here]
                if values:
                    order = np.lexsort((x, code))
                    x, code = x[order], code[order]
                    starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (x[1:] != x[:-1]))[: len(x)])
                    n = np.diff(starts, append=len(x))
                    x, code = x[starts], code[starts]
                    b = np.searchsorted(own, x, "right")
                else:
                    both = code.astype(np.int64) * (len(own) + 1) + np.searchsorted(own, x, "right")
                    if len(named) * (len(own) + 1) <= MOST_COUNTS:
                        n = np.bincount(both)
                        both = np.flatnonzero(n)
                        n = n[both]
                    else:
                        both, n = np.unique(both, return_counts=True)
                    code, b = np.divmod(both, len(own) + 1)
                    x = None
                columns = [named.take(pa.array(code)), np.full(len(n), k, np.int32), b, pa.nulls(len(n), pa.float64()) if x is None else x, n]
                yield pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, np.ndarray) else v for v in columns], ["key", "c", "b", "x", "n"])
            code, n = np.unique(codes[empty], return_counts=True)
            none = [pa.array(np.full(len(n), -1, np.int32)), pa.array(np.full(len(n), -1)), pa.nulls(len(n), pa.float64())]
            yield pa.RecordBatch.from_arrays([named.take(pa.array(code)), *none, pa.array(n)], ["key", "c", "b", "x", "n"])

    return data.mapInArrow(run, schema)


def class_quantiles(
    df: DataFrame,
    key: Column,
    columns: dict[str, Column],
    probabilities: list[float],
    rows: int,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(key, one array of quantiles per column) for every class, all classes in the same jobs.

    Up to ``bucket_rows`` rows, cells are merged by class, column and value and read off in one window.
    Beyond, value ranges of each column are shared by its classes.  Rows are counted by class, column
    and range; only ranges that hold a wanted rank are read again, merged by value and sorted, so no
    task holds a large class and nothing is collected but the limits and numbers of ranges.  Tasks count
    and merge their cells a block of rows at a time, before Spark does.
    """
    names = [f"x{k}" for k in range(len(columns))]
    data = df.select(key.alias("key"), *[(x + 0.0).cast("double").alias(n) for n, x in zip(names, columns.values())])
    data = data.where("key is not null")
    group = Window.partitionBy("key", "c")

    def ranks_in(end: Column, n: Column) -> Column:
        wanted = F.flatten(F.array(*[
            F.array(F.floor((F.col("total") - 1) * p), F.ceil((F.col("total") - 1) * p))
            for p in probabilities
        ]))
        return F.when(F.col("c") >= 0, F.array_distinct(F.filter(wanted, lambda r: (r >= end - n) & (r < end))))

    def merged(rows_: DataFrame, *by: str) -> DataFrame:
        return rows_.groupBy("key", "c", *by).agg(F.sum("n").alias("n"))

    def summed(counts: DataFrame, window: Window, order: str) -> Column:
        return F.sum("n").over(window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))

    if bucket_count(rows, bucket_rows) == 1:
        counts = merged(class_cells(data, [np.empty(0)] * len(names)), "x")
        placed = counts.select(
            "*", summed(counts, group, "x").alias("end"), F.sum("n").over(group).alias("total")
        )
        at = placed.select("key", "c", "total", "x", F.explode_outer(ranks_in(F.col("end"), F.col("n"))).alias("rank"))
        at = at.where("rank is not null or c < 0")
    else:
        limits = range_limits(data, names, rows, bucket_rows)
        ranges = merged(class_cells(data, limits, values=False), "b")
        ranges = ranges.select(
            "*", summed(ranges, group, "b").alias("end"), F.sum("n").over(group).alias("total")
        )
        needed = ranges.select(
            "key", "c", "b", (F.col("end") - F.col("n")).alias("before"),
            ranks_in(F.col("end"), F.col("n")).alias("ranks"), "total",
        ).where("ranks is null or size(ranks) > 0")
        # A few ranges of each class and column; where that is little, rows are counted but once.
        few = needed.limit(FEW_RANGES + 1).collect()
        if len(few) <= FEW_RANGES:
            needed, found = df.sparkSession.createDataFrame(few, needed.schema), few
        else:
            found = needed.select("c", "b").distinct().collect()  # at most all ranges
        needed, empty = needed.where("c >= 0"), needed.where("c < 0")
        kept = [np.zeros(len(own) + 1, bool) for own in limits]
        for r in found:
            if r["c"] >= 0:
                kept[r["c"]][r["b"]] = True
        cells = class_cells(data, limits, kept)
        counts = merged(cells.join(needed.select("key", "c", "b"), ["key", "c", "b"]), "b", "x")
        inside = Window.partitionBy("key", "c", "b")
        placed = counts.select("*", summed(counts, inside, "x").alias("upto")).join(needed, ["key", "c", "b"])
        end = F.col("before") + F.col("upto")
        here = F.filter("ranks", lambda r: (r >= end - F.col("n")) & (r < end))
        at = placed.select("key", "c", "total", "x", F.explode(here).alias("rank"))
        empty = empty.select("key", "c", "total", *[
            F.lit(None).cast(kind).alias(n) for n, kind in (("x", "double"), ("rank", "bigint"))
        ])
        at = at.unionByName(empty)
    # A few ranks of each class and column.
    place = F.when(F.col("rank").isNotNull(), F.struct("rank", "x"))
    wide = at.groupBy("key").agg(*[
        f for k, n in enumerate(names) for f in (
            F.map_from_entries(F.collect_list(F.when(F.col("c") == k, place))).alias(n),
            F.max(F.when(F.col("c") == k, F.col("total"))).alias(f"n_{n}"),
        )
    ])

    def quantile(name: str, p: float) -> Column:
        h = (F.col(f"n_{name}") - 1) * F.lit(p)
        low, high = F.col(name)[F.floor(h)], F.col(name)[F.ceil(h)]
        return F.when(low == high, low).otherwise(low + (high - low) * (h - F.floor(h)))

    found = [
        F.when(F.col(f"n_{n}").isNotNull(), F.array(*[quantile(n, p) for p in probabilities])).alias(n) for n in names
    ]
    return wide.select("key", *found).toDF("key", *columns)


def levene(
    df: DataFrame, key: Column, columns: dict[str, Column], classes: int, rows: int,
    bucket_rows: int = BUCKET_ROWS,
) -> dict[str, OneWay]:
    """One-way layout of the distances to the class medians (Levene, median-centred)."""
    if not columns:
        return {}
    names = [f"x{k}" for k in range(len(columns))]
    medians = class_quantiles(df, key, columns, [0.5], rows, bucket_rows)
    if classes <= BROADCAST_CLASSES:
        medians = F.broadcast(medians)
    data = df.select(key.alias("key"), *[x.alias(n) for n, x in zip(names, columns.values())])
    both = data.join(medians.toDF("key", *[f"med{k}" for k in range(len(names))]), "key")
    away = {c: F.abs(F.col(f"x{k}") - F.col(f"med{k}")[0]) for k, c in enumerate(columns)}
    return one_way(both, F.col("key"), away, min_rows=2)
