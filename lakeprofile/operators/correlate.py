"""Pairwise correlation over complete pairs."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprofile.functions.columns import aggregate_once, as_double
from lakeprofile.operators.moments import Moments
from lakeprofile.operators.ranks import (
    BLOCK_ROWS, BUCKET_ROWS, blocks, numbers, own_ranges, range_counts, range_limits,
)

# More columns than this are correlated by products of whole batches of rows.
GRAM_COLUMNS = 12

Pair = tuple[str, str]


def pair_correlations(
    df: DataFrame,
    x: dict[str, Column],
    centre: dict[str, float],
    gappy: set[str],
    pairs: Iterable[Pair],
) -> dict[Pair, tuple[int, float | None]]:
    """(complete pairs, Pearson r) of each pair of double-valued expressions.

    All pairs share the scans: sums of products about a fixed centre, so nothing is shuffled but
    one row per task.  Pairs without gaps share their counts and squares.
    """
    pairs = list(pairs)
    if len({c for pair in pairs for c in pair}) > GRAM_COLUMNS:
        return _gram_correlations(df, x, centre, pairs)
    exprs: dict[tuple, Column] = {}

    def names(a: str, b: str) -> dict[str, tuple]:
        if a not in gappy and b not in gappy:
            one, two = (a,), (b,)
        else:
            one, two = (a, b), (b, a)
        return {"n": ("n", *sorted(one if len(one) == 2 else ())),
                "sa": ("s", *one), "sb": ("s", *two), "qa": ("q", *one), "qb": ("q", *two),
                "ab": ("p", *sorted((a, b)))}

    for a, b in pairs:
        both = x[a].isNotNull() & x[b].isNotNull()
        masked = a in gappy or b in gappy
        da, db = x[a] - F.lit(centre[a]), x[b] - F.lit(centre[b])
        if masked:
            da, db = F.when(both, da), F.when(both, db)
        key = names(a, b)
        exprs.setdefault(key["n"], F.count_if(both) if masked else F.count(F.lit(1)))
        exprs.setdefault(key["sa"], F.sum(da))
        exprs.setdefault(key["sb"], F.sum(db))
        exprs.setdefault(key["qa"], F.sum(da * da))
        exprs.setdefault(key["qb"], F.sum(db * db))
        exprs.setdefault(key["ab"], F.sum(da * db))
    got = aggregate_once(df, exprs) if exprs else {}
    out = {}
    for a, b in pairs:
        v = {k: got[name] for k, name in names(a, b).items()}
        out[a, b] = (v["n"], _r(v, centre[a], centre[b]))
    return out


def _gram_correlations(
    df: DataFrame, x: dict[str, Column], centre: dict[str, float], pairs: list[Pair]
) -> dict[Pair, tuple[int, float | None]]:
    """The same sums for many columns, from one scan: every task adds up matrices of products, and
    Spark adds up the tasks' matrices cell by cell."""
    names = sorted({c for pair in pairs for c in pair})
    k = len(names)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, p = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            there = ~np.isnan(values)
            values = np.where(there, values, 0.0)
            mask = there.astype(float)
            n += mask.T @ mask
            s += values.T @ mask  # sums of a row's column where the other one is present
            q += (values * values).T @ mask
            p += values.T @ values
        columns = [np.arange(k * k), *(m.ravel() for m in (n, s, q, p))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "n", "s", "q", "p"])

    data = df.select(*[(x[c] - F.lit(centre[c])).cast("double").alias(str(i)) for i, c in enumerate(names)])
    cells = data.mapInArrow(sums, "cell long, n double, s double, q double, p double")
    totals = cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in "nsqp"]).collect()
    at = {r["cell"]: r for r in totals}
    place, out = {c: i for i, c in enumerate(names)}, {}
    for a, b in pairs:
        one, two = (at.get(place[i] * k + place[j]) for i, j in ((a, b), (b, a)))
        if one is None:
            out[a, b] = (0, None)
            continue
        v = {"n": int(one["n"]), "sa": one["s"], "sb": two["s"], "qa": one["q"], "qb": two["q"], "ab": one["p"]}
        out[a, b] = (v["n"], _r(v, centre[a], centre[b]))
    return out


def _r(v: dict, centre_a: float, centre_b: float) -> float | None:
    n = v["n"]
    if n < 2:
        return None
    var_a = v["qa"] / n - (v["sa"] / n) ** 2
    var_b = v["qb"] / n - (v["sb"] / n) ** 2
    # Below rounding noise the column is constant over the pairs.
    if var_a <= (abs(centre_a) * 1e-14) ** 2 or var_b <= (abs(centre_b) * 1e-14) ** 2:
        return None
    cov = v["ab"] / n - v["sa"] / n * (v["sb"] / n)
    r = cov / math.sqrt(var_a * var_b)
    return None if math.isnan(r) else max(-1.0, min(1.0, r))


def pearson_pairs(
    df: DataFrame, columns: list[str], moments: dict[str, Moments], rows: int
) -> dict[Pair, float | None]:
    """Pearson r of every pair of numeric columns (upper triangle)."""
    usable = [c for c in columns if moments[c].count > 0]
    got = pair_correlations(
        df, {c: as_double(df, c) for c in usable}, {c: moments[c].mean for c in usable},
        {c for c in usable if moments[c].count < rows},
        combinations([c for c in usable if moments[c].minimum != moments[c].maximum], 2),
    )
    return {p: got.get(p, (0, None))[1] for p in combinations(columns, 2)}


def spearman_pairs(
    df: DataFrame,
    columns: list[str],
    moments: dict[str, Moments],
    rows: int,
    bucket_rows: int = BUCKET_ROWS,
) -> dict[Pair, float | None]:
    """Spearman rho of every pair, ranked over the complete rows of that pair.

    Each value has a rank for every column with gaps, among the rows where that column is present; the
    ranks come from the same running sums (`_with_ranks`), and one aggregate sums all pairs.
    """
    out: dict[Pair, float | None] = dict.fromkeys(combinations(columns, 2))
    varying = [
        c for c in columns if moments[c].count > 1 and moments[c].minimum != moments[c].maximum
    ]
    if len(varying) < 2 or rows < 2:
        return out
    place = {c: k for k, c in enumerate(varying)}
    gappy = [c for c in varying if moments[c].count < rows]
    ranked = _with_ranks(df, place, gappy, rows, bucket_rows)
    exprs: dict[tuple, Column] = {}
    pairs = list(combinations(varying, 2))
    for a, b in pairs:
        one = F.col(f"r{place[a]}_{place[b]}" if b in gappy else f"r{place[a]}")
        two = F.col(f"r{place[b]}_{place[a]}" if a in gappy else f"r{place[b]}")
        both = one.isNotNull() & two.isNotNull()
        middle = F.lit((min(moments[a].count, moments[b].count) + 1) / 2)
        da, db = F.when(both, one - middle), F.when(both, two - middle)
        exprs |= {(a, b, "n"): F.count(da), (a, b, "sa"): F.sum(da), (a, b, "sb"): F.sum(db),
                  (a, b, "qa"): F.sum(da * da), (a, b, "qb"): F.sum(db * db),
                  (a, b, "ab"): F.sum(da * db)}
    # All in one pass, so that nothing is ranked twice.
    got = aggregate_once(ranked, exprs, at_once=len(exprs))
    for a, b in pairs:
        sums = {k: got[a, b, k] for k in ("n", "sa", "sb", "qa", "qb", "ab")}
        out[a, b] = _r(sums, 0.0, 0.0)
    return out


def _cells(limits: list[np.ndarray], gappy: list[int], size: int):
    """Rows to cells: for every block of rows, the values of each range, where they are, and a bit for
    each column with gaps that has a value there."""
    alone = [own_ranges(own) for own in limits]
    kind = pa.schema([
        ("block", pa.int64()), ("rows", pa.int32()), ("c", pa.int32()), ("b", pa.int32()), ("deal", pa.int64()),
        ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float64())), ("there", pa.binary()),
    ])
    width = -(-len(gappy) // 8)  # bytes of bits for each cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for number, block in enumerate(blocks(batches, size)):
            cells = [numbers(c) for c in block.columns]
            bits = np.zeros((len(block), 8 * width), bool)
            for j, p in enumerate(gappy):
                bits[:, j] = cells[p][1]
            bits = np.packbits(bits, axis=1)
            for k, (x, there) in enumerate(cells):
                at = np.flatnonzero(there)
                b = np.searchsorted(limits[k], x[at], "right")
                order = np.argsort(b, kind="stable")
                at, b = at[order], b[order]
                starts = np.flatnonzero(np.diff(b, prepend=-1))
                ends = np.append(starts, len(b)).astype(np.int32)
                b = b[starts]
                flags = pa.BinaryArray.from_buffers(
                    pa.binary(), len(b), [None, pa.py_buffer(ends * np.int32(width)), pa.py_buffer(bits[at].tobytes())]
                )
                columns = [
                    np.full(len(b), first + number), np.full(len(b), len(block)), np.full(len(b), k), b,
                    np.where(alone[k][b], first + number, -1),
                ]
                lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(at, pa.int32()), pa.array(x[at]))]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(v, f.type) for v, f in zip(columns, kind)], *lists, flags], names=kind.names
                )

    return run


def _ranked(limits: list[np.ndarray], partners: list[list[int]]):
    """Cells of one range to twice their ranks inside the range, one for each partner of their column;
    partner -1 stands for all rows, others for a bit."""
    alone = [own_ranges(own) for own in limits]

    def run(key: tuple, cells: pa.Table) -> pa.Table:
        cells = cells.combine_chunks()
        k, b = key[0].as_py(), key[1].as_py()
        out = cells.select(["block", "rows", "c", "b", "at"])
        if alone[k][b]:  # its ranks are known from the counts
            none = pa.nulls(len(cells), pa.list_(pa.int64()))
            return out.append_column("ranks", none)
        lists = cells.column("x").combine_chunks()
        x = lists.flatten().to_numpy()
        bits = np.frombuffer(b"".join(cells.column("there").to_pylist()), np.uint8).reshape(len(x), -1)
        order = np.argsort(x, kind="stable")
        new = np.append(True, x[order[1:]] != x[order[:-1]])
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        ranks = np.empty((len(x), len(partners[k])), np.int64)
        for j, p in enumerate(partners[k]):
            met = np.ones(len(x), np.int64) if p < 0 else bits[order, p // 8] >> (7 - p % 8) & 1
            upto = np.append(0, np.cumsum(met, dtype=np.int64))
            twice = upto[starts] + upto[np.append(starts[1:], len(x))] + 1
            ranks[order, j] = twice[group]
        ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy())) * len(partners[k])
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ranks.reshape(-1)))
        return out.append_column("ranks", listed)

    return run


def _with_ranks(
    df: DataFrame, place: dict[str, int], gappy: list[str], rows: int, bucket_rows: int
) -> DataFrame:
    """The ranks r<k> of each column and r<k>_<b> among the rows where a column b with gaps has a value;
    rows without any value are left out, and so is r<k> where no pair needs it.

    Rows are numbered in blocks. Only cells are shuffled, each once to the value range that ranks it and
    once, with the ranks, to its block. Cells of a value that many rows hold are dealt by block, as the
    counts of all ranges are known before. Rows are sorted inside their task before they are numbered, so
    that a task that runs again numbers them alike whatever order they come in.
    """
    names = [f"x{k}" for k in place.values()]
    # -0.0 and 0.0 are one value.
    data = df.select(*[(as_double(df, c) + 0.0).alias(n) for c, n in zip(place, names)])
    position = {c: i for i, c in enumerate(place)}
    gaps = [position[c] for c in gappy]
    partners = []  # of each column: -1 for all rows, and places in `gaps`
    for c in place:
        everywhere = any(b != c and b not in gappy for b in place)
        partners.append([-1] * everywhere + [j for j, b in enumerate(gappy) if b != c])
    limits = range_limits(data, names, rows, bucket_rows)
    counts = range_counts(data, names, limits, gaps)
    size = max(1024, min(BLOCK_ROWS, (1 << 22) // len(place) ** 2))
    cells = data.sortWithinPartitions(*names).mapInArrow(
        _cells(limits, gaps, size),
        "block long, rows int, c int, b int, deal long, at array<int>, x array<double>, there binary",
    )
    ranked = cells.groupBy("c", "b", "deal").applyInArrow(
        _ranked(limits, partners), "block long, rows int, c int, b int, at array<int>, ranks array<long>"
    )
    wanted = [(i, j, p) for i, own in enumerate(partners) for j, p in enumerate(own)]
    label = list(place.values())
    ends = [f"r{label[i]}" + (f"_{place[gappy[p]]}" if p >= 0 else "") for i, _, p in wanted]
    # Of every range twice the ranks before it, and of a single value's what its rank adds.
    before = [2 * (np.cumsum(n, axis=0) - n) for n in counts]
    single = [n + 1 for n in counts]
    held = df.sparkSession.sparkContext.broadcast((before, single))

    def joined(cells: pa.Table) -> pa.Table:
        before, single = held.value
        n = cells.column("rows")[0].as_py()
        out = [[np.full(n, np.nan) for _ in own] for own in partners]
        columns = [cells.column(c).combine_chunks() for c in ("c", "b", "at", "ranks")]
        for k, b, at, ranks in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], columns[3]):
            at, own = at.values.to_numpy(), partners[k]
            inside = ranks.values.to_numpy().reshape(-1, len(own)) if ranks.is_valid else None
            for j, p in enumerate(own):
                twice = single[k][b, p + 1] if inside is None else inside[:, j]
                out[k][j][at] = (before[k][b, p + 1] + twice) / 2
        return pa.table([pa.array(out[i][j], from_pandas=True) for i, j, _ in wanted], ends)

    return ranked.groupBy("block").applyInArrow(joined, ", ".join(f"{e} double" for e in ends))


def vif_values(
    df: DataFrame,
    columns: list[str],
    centre: dict[str, float],
    gaps: list[str],
    rows: int,
    pearson: dict[Pair, float | None] | None,
) -> dict[str, float | None] | None:
    """Variance inflation factors with intercept; None below ten complete rows a column.

    One pass sums the products of all pairs over the complete rows (without gaps the Pearson
    matrix is already that); each factor then follows from the small correlation matrix.
    """
    if len(columns) < 2:
        return None
    r = pearson
    if gaps:
        x = {c: as_double(df, c) for c in columns}
        complete = df
        for c in gaps:
            complete = complete.where(x[c].isNotNull())
        got = pair_correlations(complete, x, centre, set(), combinations(columns, 2))
        rows, r = next(iter(got.values()))[0], {k: v for k, (_, v) in got.items()}
    if rows < 10 * len(columns):
        return None
    return inflation(columns, r)


def inflation(columns: list[str], r: dict[Pair, float | None]) -> dict[str, float | None]:
    """Factors from pairwise correlations; None for a constant column, inf for a dependent one."""
    varying = [
        c for c in columns if any(r[pair] is not None for pair in r if c in pair)
    ]
    k = len(varying)
    matrix = np.eye(k)
    for i, j in combinations(range(k), 2):
        a, b = varying[i], varying[j]
        matrix[i, j] = matrix[j, i] = r[a, b] if (a, b) in r else r[b, a]
    out: dict[str, float | None] = dict.fromkeys(columns)
    for i, c in enumerate(varying):
        rest = [j for j in range(k) if j != i]
        if not rest:
            out[c] = 1.0
            continue
        links = matrix[i, rest]
        inner = np.linalg.pinv(matrix[np.ix_(rest, rest)], rcond=1e-12, hermitian=True)
        unexplained = 1 - float(links @ inner @ links)
        out[c] = 1 / unexplained if unexplained > 1e-13 else math.inf
    return out
