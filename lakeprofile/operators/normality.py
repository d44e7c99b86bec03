"""Shapiro-Wilk's W as sums over ranks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprofile.functions.columns import as_double
from lakeprofile.functions.pvalues import (
    NORMAL_CENTRE, NORMAL_FAR, NORMAL_TAIL, shapiro_end_weights,
)
from lakeprofile.operators.ranks import (
    BUCKET_ROWS, blocks, numbers, own_ranges, range_counts, range_limits,
)

#: Copies of a value that has a range of its own are dealt in parts of this many.
COPIES = 10_000
#: Ranks that a task holds at once.
STRETCH = 1 << 18


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1, by Wichura's AS 241."""

    def ratio(tables: tuple[list[float], list[float]], r: Column) -> Column:
        above, below = (reduce(lambda acc, a: acc * r + F.lit(a), t[1:], F.lit(t[0])) for t in tables)
        return above / below

    q = p - 0.5
    far = F.sqrt(-F.log(F.when(q <= 0, p).otherwise(1 - p)))
    tail = F.when(far <= 5, ratio(NORMAL_TAIL, far - 1.6)).otherwise(ratio(NORMAL_FAR, far - 5))
    return F.when(F.abs(q) <= 0.425, q * ratio(NORMAL_CENTRE, 0.180625 - q * q)).otherwise(F.sign(q) * tail)


def _quantiles(p: np.ndarray) -> np.ndarray:
    """`normal_quantile` of an array."""

    def ratio(tables: tuple[list[float], list[float]], r: np.ndarray) -> np.ndarray:
        above, below = (reduce(lambda acc, a: acc * r + a, t[1:], t[0]) for t in tables)
        return above / below

    q = p - 0.5
    out = q * ratio(NORMAL_CENTRE, 0.180625 - q * q)
    outer = np.abs(q) > 0.425
    p, q = p[outer], q[outer]
    far = np.sqrt(-np.log(np.where(q <= 0, p, 1 - p)))
    tail = ratio(NORMAL_TAIL, far - 1.6)
    tail[far > 5] = ratio(NORMAL_FAR, far[far > 5] - 5)
    out[outer] = np.sign(q) * tail
    return out


def _cells(limits: list[np.ndarray], alone: list[np.ndarray]):
    """Values and their counts of each range, a row per block; ranges of a single value are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for k, column in enumerate(block.columns):
                x, there = numbers(column)
                x = x[there]
                if alone[k].any():
                    x = x[~alone[k][np.searchsorted(limits[k], x, "right")]]
                x, n = np.unique(x, return_counts=True)
                b = np.searchsorted(limits[k], x, "right")
                starts = np.flatnonzero(np.diff(b, prepend=-1))
                ends = pa.array(np.append(starts, len(b)), pa.int32())
                columns = [pa.array(np.full(len(starts), k, np.int32)), pa.array(b[starts])]
                columns += [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (x, n)]
                yield pa.RecordBatch.from_arrays(columns, ["c", "b", "x", "n"])

    return run


def _merged(key: tuple, cells: pa.Table) -> tuple:
    """(c, b, values in order, counts, 0) of one range, equal values merged."""
    x, n = (cells.column(name).combine_chunks().flatten().to_numpy() for name in ("x", "n"))
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return key[0].as_py(), key[1].as_py(), x[starts], np.add.reduceat(n, starts), 0


#: What a run of ranks adds: three sums, and the values at the two lowest and the two highest ranks.
SUMS = ["total", "norm", "inner", "x1", "x2", "y2", "y1"]


def _sums(before: list[np.ndarray], sizes: list[int], means: list[float]):
    """Runs (c, b, values, counts, ranks of the range before them) to what their ranks add."""

    def run(runs: list[tuple]) -> pa.Table:
        out = []
        for c, b, x, n, after in runs:
            size, d, last = sizes[c], x - means[c], np.cumsum(n)
            start, ranks = int(before[c][b]) + after, int(last[-1])
            norm = inner = 0.0
            for at in range(0, ranks, STRETCH):
                i = np.arange(at, min(ranks, at + STRETCH))
                low, high = np.searchsorted(last, [i[0], i[-1]], "right")
                held = np.diff(np.minimum(last[low : high + 1], i[-1] + 1), prepend=at)
                i += start + 1
                m = _quantiles((i - 0.375) / (size + 0.25))
                norm += float(m @ m)
                m[(i <= 2) | (i >= size - 1)] = 0.0
                inner += float(m @ np.repeat(d[low : high + 1], held))
            ends = [e - start for e in (1, 2, size - 1, size)]
            ends = [float(x[np.searchsorted(last, e)]) if 1 <= e <= ranks else None for e in ends]
            out.append((c, float(n @ (d * d)), norm, inner, *ends))
        kinds = [pa.int32(), *[pa.float64()] * len(SUMS)]
        return pa.table([pa.array(v, kind) for v, kind in zip(zip(*out), kinds)], ["c", *SUMS])

    return run


def shapiro_w(
    df: DataFrame,
    columns: list[str],
    rows: dict[str, int],
    means: dict[str, float],
    bucket_rows: int = BUCKET_ROWS,
    copies: int = COPIES,
) -> dict[str, float]:
    """W of columns with ``rows`` present values (8 at least) around ``means``, of any number.

    Values are counted by range, cells shuffled once, copies of a block as one, and each rank adds its
    share to a few sums per column; no task sees a column. A value that many rows hold has a range of
    its own: it isn't shuffled, its ranks are dealt in parts of ``copies``. A column of one value has
    W = 1.
    """
    if not columns:
        return {}
    names = [str(k) for k in range(len(columns))]
    # 0.0 and -0.0 are the same value.
    values = df.select(*[(as_double(df, c) + 0.0).alias(k) for c, k in zip(columns, names)])
    limits = range_limits(values, names, max(rows[c] for c in columns), bucket_rows)
    counts = [n[:, 0] for n in range_counts(values, names, limits)]
    alone = [own_ranges(own) for own in limits]
    sums = _sums([np.cumsum(n) - n for n in counts], [rows[c] for c in columns], [float(means[c]) for c in columns])
    kinds = "c int, " + ", ".join(f"{name} double" for name in SUMS)
    cells = values.mapInArrow(_cells(limits, alone), "c int, b long, x array<double>, n array<long>")
    parts = cells.groupBy("c", "b").applyInArrow(lambda key, block: sums([_merged(key, block)]), kinds)
    single = [
        (k, int(b), float(limits[k][b - 1]), int(counts[k][b]))
        for k in range(len(columns)) for b in np.flatnonzero(alone[k] & (counts[k] > 0))
    ]
    if single:
        part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / copies)))
        hot = df.sparkSession.createDataFrame(single, "c int, b long, x double, n long").withColumn("j", part)
        hot = hot.repartition("c", "x", "j")
        hot = hot.select("c", "b", "x", F.least(F.lit(copies), F.col("n") - F.col("j") * copies).alias("n"), (F.col("j") * copies).alias("after"))

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows_ = zip(*[v.to_pylist() for v in batch.columns])
                got = sums([(c, b, np.array([x]), np.array([n]), after) for c, b, x, n, after in rows_])
                yield from got.to_batches()

        parts = parts.unionByName(hot.mapInArrow(pieces, kinds))
    found = parts.groupBy("c").agg(
        *[F.sum(name).alias(name) for name in SUMS[:3]], *[F.max(name).alias(name) for name in SUMS[3:]]
    )
    sizes = sorted({rows[c] for c in columns})
    ends = [normal_quantile((F.lit(float(n - k)) - 0.375) / (n + 0.25)) for n in sizes for k in (0, 1)]
    ends = list(df.sparkSession.range(1).select(*ends).first())
    ends = {n: ends[2 * i : 2 * i + 2] for i, n in enumerate(sizes)}
    out = {}
    for r in found.collect():  # one row per column
        c = columns[r["c"]]
        if r["x1"] == r["y1"] or not r["total"]:
            out[c] = 1.0
            continue
        a1, a2, scale = shapiro_end_weights(rows[c], r["norm"], *ends[rows[c]])
        top = a1 * (r["y1"] - r["x1"]) + a2 * (r["y2"] - r["x2"]) + r["inner"] / scale
        out[c] = min(1.0, top * top / r["total"])
    return out
