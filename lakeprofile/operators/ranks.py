"""Exact ranks and cumulative counts over whole columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lakeprofile.operators.sketch import quantiles_of, sketched_quantiles, sketches

# A window sorts one range of distinct values; ranges hold about this many rows.
BUCKET_ROWS = 1_000_000
# Ranges that a column is cut into at once, and again where one is too large.
CUTS = 1024
# Limits of all ranges of a table, 8 bytes each: beyond, ranges hold more rows.
MOST_LIMITS = 2_000_000
_SKETCH = 16_384
# Rows of a task that are cut into ranges at once.
BLOCK_ROWS = 1 << 16


def bucket_count(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    return max(1, math.ceil(rows / bucket_rows))


def _cut(cells: DataFrame, limits: dict[int, np.ndarray]) -> DataFrame:
    """Adds the number of the range that a cell falls into: how many limits of its column are at or below it.

    The limits, MOST_LIMITS at most, are broadcast and searched a batch at a time."""
    held = cells.sparkSession.sparkContext.broadcast(limits)
    at = cells.columns.index("c"), cells.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, x = (batch.column(i) for i in at)
            there = x.is_valid().to_numpy(zero_copy_only=False)
            x, c = x.to_numpy(zero_copy_only=False), c.fill_null(-1).to_numpy()
            number = np.zeros(len(x), np.int64)
            for k, own in held.value.items():
                here = there & (c == k)
                number[here] = np.searchsorted(own, x[here], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], [*batch.schema.names, "b"])

    return cells.mapInArrow(run, StructType([*cells.schema.fields, StructField("b", LongType())]))


def in_ranges(
    cells: DataFrame, columns: int, rows: int, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Adds b to the cells (c, x, ...) of some columns: ranges of about ``bucket_rows`` rows, in order.

    A sketch of fixed size cuts each column into at most CUTS ranges; where more are wanted, exact
    counts show which of these are too large, and only those are sketched and cut again, so that
    neither a sketch nor the plan grows with the table.  The limits, MOST_LIMITS at most, only steer the balance: any limits give exact
    results, and as stored values they stay the same when a lost task is run again.
    """
    bucket_rows = max(bucket_rows, math.ceil(rows * columns / MOST_LIMITS))
    ranges = bucket_count(rows, bucket_rows)
    if ranges == 1 or not columns:
        return cells.withColumn("b", F.lit(0).cast("bigint"))
    first = min(ranges, CUTS)
    found = sketches(cells.select("c", "x"), ["c"], _SKETCH)
    found = found.select("c", quantiles_of("sketch", [k / first for k in range(1, first)])).collect()
    limits = {c: np.unique(np.array(q, float)) for c, q in found}
    if ranges == first:
        return _cut(cells, limits)

    values = _cut(cells.select("c", "x").where("x is not null"), limits)
    large = values.groupBy("c", "b").agg(F.count("*").alias("n")).where(F.col("n") > 2 * bucket_rows)
    again = values.join(F.broadcast(large.select("c", "b")), ["c", "b"])  # CUTS rows a column
    parts = F.least(F.lit(CUTS), F.ceil(F.col("n") / bucket_rows))
    grid = F.posexplode(quantiles_of("sketch", [k / CUTS for k in range(1, CUTS)])).alias("k", "limit")
    # Of the grid as many limits as parts are wanted, evenly.
    every = sketches(again, ["c", "b"], _SKETCH).select("c", "b", parts.alias("parts"), grid)
    place = [F.floor((F.col("k") + up) * F.col("parts") / CUTS) for up in (0, 1)]
    picked = every.where(place[1] > place[0]).groupBy("c", "b").agg(F.collect_set("limit").alias("limits"))
    more: dict[int, list] = {}
    for c, got in picked.select("c", "limits").collect():
        more.setdefault(c, [limits[c]]).append(np.array(got, float))
    return _cut(cells, limits | {c: np.unique(np.concatenate(parts)) for c, parts in more.items()})


def cumulative_counts(
    df: DataFrame,
    x: Column,
    rows: int,
    bucket_rows: int = BUCKET_ROWS,
    partners: dict[str, Column] | None = None,
) -> DataFrame:
    """(x, n, before): each distinct present value, its count and the count of smaller values.

    Copies of a value are merged before anything is sorted, so a hot value is one row; the running
    sum is taken inside value ranges and shifted by the totals of the ranges before.  For every
    partner, a condition, n_<name> and before_<name> count the rows that meet it.
    """
    partners = partners or {}
    flags = [p.cast("bigint").alias(f"n_{name}") for name, p in partners.items()]
    one = F.lit(1).cast("bigint").alias("n")
    data = df.select(F.lit(0).alias("c"), x.alias("x"), one, *flags).where("x is not null")
    names = ["n", *[f"n_{name}" for name in partners]]
    data = in_ranges(data, 1, rows, bucket_rows).withColumnRenamed("b", "bucket")
    counts = data.groupBy("bucket", "x").agg(*[F.sum(n).alias(n) for n in names])
    inside = (
        Window.partitionBy("bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = {n: "before" + n[1:] for n in names}
    local = counts.select(
        "*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(b) for n, b in before.items()]
    )
    if bucket_count(rows, bucket_rows) > 1:
        totals = counts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])
        # One row per range.
        across = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        shifts = totals.select(
            "bucket", *[F.coalesce(F.sum(n).over(across), F.lit(0)).alias(f"shift_{n}") for n in names]
        )
        local = local.join(shifts, "bucket").select(
            "x", *names, *[(F.col(b) + F.col(f"shift_{n}")).alias(b) for n, b in before.items()]
        )
    return local.select("x", *names, *before.values())


def average_ranks(
    df: DataFrame,
    x: Column,
    rows: int,
    bucket_rows: int = BUCKET_ROWS,
    partners: dict[str, Column] | None = None,
) -> DataFrame:
    """(x, n, rank): every distinct value, its count and the average 1-based rank of its copies;
    rank_<name> is the rank among the rows that meet a partner's condition."""
    counts = cumulative_counts(df, x, rows, bucket_rows, partners)
    ranks = [
        (F.col(f"before{end}") + (F.col(f"n{end}") + 1) / 2).alias(f"rank{end}")
        for end in ("", *[f"_{name}" for name in partners or {}])
    ]
    return counts.select("x", "n", *ranks)


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.Table]:
    """The same rows in blocks of ``rows``, whatever the size of the batches."""
    held, n = [], 0
    for batch in batches:
        while len(batch):
            take = min(len(batch), rows - n)
            held.append(batch.slice(0, take))
            batch, n = batch.slice(take), n + take
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether present) of a column of doubles."""
    there = column.is_valid().to_numpy()
    return column.to_numpy(), there


def range_limits(
    wide: DataFrame, names: list[str], rows: int, bucket_rows: int = BUCKET_ROWS
) -> list[np.ndarray]:
    """Limits that cut each column of doubles into ranges of about ``bucket_rows`` rows, CUTS at most.

    They come from one scan of sketches of fixed size, and any limits give exact results. A value that
    takes more than about two in CUTS of the rows has a range of its own (`own_ranges`).
    """
    ranges = min(bucket_count(rows, bucket_rows), CUTS, max(1, MOST_LIMITS // len(names) ** 2))
    if ranges == 1:
        return [np.empty(0) for _ in names]
    grid = [k / CUTS for k in range(1, CUTS)]
    found = sketched_quantiles(wide, {n: (F.col(n), grid) for n in names}, _SKETCH)
    limits = []
    for n in names:
        q = np.array(found[n], float)
        hot = np.unique(q[1:][q[1:] == q[:-1]])
        even = q[[k * CUTS // ranges - 1 for k in range(1, ranges)]] if len(q) else q
        limits.append(np.unique(np.concatenate((even, hot, np.nextafter(hot, np.inf)))))
    return limits


def own_ranges(limits: np.ndarray) -> np.ndarray:
    """Whether each range of a column, one more than its limits, holds a single value."""
    alone = np.nextafter(limits[:-1], np.inf) == limits[1:]
    return np.concatenate(([False], alone, [False]))[: len(limits) + 1]


def range_counts(
    wide: DataFrame, names: list[str], limits: list[np.ndarray], partners: list[int] | None = None
) -> list[np.ndarray]:
    """For each column an array (range, 1 + partners): its values, and those of rows where a partner,
    given by its place, has one too.  Counted in the tasks, a row per range, column and task."""
    partners = partners or []
    held = wide.sparkSession.sparkContext.broadcast(limits)
    kinds = [f"n{j}" for j in range(1 + len(partners))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros((len(kinds), len(own) + 1), np.int64) for own in held.value]
        for block in blocks(batches):
            cells = [numbers(c) for c in block.columns]
            for (x, there), own, out in zip(cells, held.value, counts):
                b = np.searchsorted(own, x[there], "right")
                out[0] += np.bincount(b, minlength=len(own) + 1)
                for j, p in enumerate(partners, 1):
                    out[j] += np.bincount(b[cells[p][1][there]], minlength=len(own) + 1)
        for k, out in enumerate(counts):
            some = np.flatnonzero(out[0])
            columns = [np.full(len(some), k, np.int32), some, *[out[j][some] for j in range(len(kinds))]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["c", "b", *kinds])

    cells = wide.select(*names).mapInArrow(run, ", ".join(["c int", "b long", *[f"{n} long" for n in kinds]]))
    out = [np.zeros((len(own) + 1, len(kinds)), np.int64) for own in limits]
    for c, b, *n in cells.groupBy("c", "b").agg(*[F.sum(n).alias(n) for n in kinds]).collect():
        out[c][b] = n
    return out
