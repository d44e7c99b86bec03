"""Exact linear-interpolated quantiles without sorting a whole column."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeprofile.functions.columns import chunks
from lakeprofile.operators.sketch import sketched_quantiles

# At most this many values are sorted by one window task.
WINDOW_VALUES = 1_000_000

# Equal slices of the value range that narrow the sort of a window.
SLICES = 256

# Size of a sketch, and how far off it may well be, as a share of the values.
_SKETCH = 32_768
_SLACK = 4e-4


def wanted_ranks(count: int, probabilities: list[float]) -> list[int]:
    """0-based ranks that linear interpolation of the probabilities needs."""
    if count == 0:
        return []
    positions = [(count - 1) * p for p in probabilities]
    return sorted({math.floor(h) for h in positions} | {math.ceil(h) for h in positions})


def interpolated(
    count: int, probabilities: list[float], at_rank: dict[int, float]
) -> list[float | None]:
    out: list[float | None] = []
    for p in probabilities:
        if count == 0:
            out.append(None)
            continue
        h = (count - 1) * p
        low, high = at_rank[math.floor(h)], at_rank[math.ceil(h)]
        out.append(low if low == high else low + (high - low) * (h - math.floor(h)))
    return out


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probabilities: list[float],
    counts: dict[str, int],
    limits: dict[str, tuple[float, float]],
    window_values: int = WINDOW_VALUES,
) -> dict[str, list[float | None]]:
    """Quantiles of each double-valued expression.

    ``counts`` gives its present values, ``limits`` its smallest and largest one.
    """
    ranks = {c: wanted_ranks(counts[c], probabilities) for c in columns}
    chosen = select_ranks(df, columns, ranks, counts, limits, window_values)
    return {c: interpolated(counts[c], probabilities, chosen[c]) for c in columns}


@dataclass
class _Bracket:
    """An open value range of one column known to hold some of the wanted ranks."""

    column: str
    below: int  # values at or under the lower bound
    inside: int  # values strictly between the bounds
    low: float | None = None
    high: float | None = None
    ranks: list[int] = field(default_factory=list)

    def values(self, x: Column) -> Column:
        """x where it lies inside, else NULL."""
        cond = F.lit(True)
        if self.low is not None:
            cond &= x > self.low
        if self.high is not None:
            cond &= x < self.high
        return x if self.low is None and self.high is None else F.when(cond, x)


def select_ranks(
    df: DataFrame,
    columns: dict[str, Column],
    ranks: dict[str, list[int]],
    counts: dict[str, int],
    limits: dict[str, tuple[float, float]],
    window_values: int = WINDOW_VALUES,
) -> dict[str, dict[int, float]]:
    """Exact order statistics (0-based ranks) by narrowing brackets.

    A round is two scans that shuffle one row per task: a sketch of each bracket (the tasks' sketches are
    merged in groups, then the groups') proposes bounds around its ranks, then exact counts against the bounds say between which two each rank lies.
    A bound that equals the answer ends the search, so a hot value never has to fit into a
    bracket.  A bracket of at most ``window_values`` values is merged by value and read off.  The
    sketch only steers; the counts decide, and a round shrinks a bracket some thousandfold.
    """
    found: dict[str, dict[int, float]] = {c: {} for c in columns}
    open_ = [_Bracket(c, 0, counts[c], ranks=list(r)) for c, r in ranks.items() if r]
    small: list[_Bracket] = []
    while open_:
        wide = [b for b in open_ if b.inside > window_values]
        small += [b for b in open_ if b.inside <= window_values]
        open_ = []
        if wide:
            open_ = _narrow(df, columns, wide, found)
    for part in chunks(small, 16):
        _read_off(df, columns, part, limits, found)
    return found


def _narrow(
    df: DataFrame,
    columns: dict[str, Column],
    brackets: list[_Bracket],
    found: dict[str, dict[int, float]],
) -> list[_Bracket]:
    wanted = {}
    for k, b in enumerate(brackets):
        at = sorted(
            min(1.0, max(0.0, (r - b.below) / max(1, b.inside - 1) + d))
            for r in b.ranks
            for d in (-_SLACK, _SLACK)
        )
        wanted[k] = b.values(columns[b.column]), at
    bounds = {k: sorted(set(v)) for k, v in sketched_quantiles(df, wanted, _SKETCH).items()}
    got = _tallies(df, columns, brackets, bounds)
    out = []
    for k, b in enumerate(brackets):
        edges = [b.low, *bounds[k], b.high]
        upto = [b.below, *[b.below + got[k, "le", e] for e in bounds[k]]]
        under = [*[b.below + got[k, "lt", e] for e in bounds[k]], b.below + b.inside]
        for j, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
            held = [r for r in b.ranks if upto[j] <= r < under[j]]
            if held:
                out.append(_Bracket(b.column, upto[j], under[j] - upto[j], low, high, held))
        for j, bound in enumerate(bounds[k]):
            for r in b.ranks:
                if under[j] <= r < upto[j + 1]:
                    found[b.column][r] = float(bound)
    return out


def _tallies(
    df: DataFrame, columns: dict[str, Column], brackets: list[_Bracket], bounds: dict[int, list]
) -> dict[tuple, int]:
    """Values of each bracket under, and at or under, each of its bounds, in one scan for all.

    A value is counted by how many bounds lie below it and by whether it equals the next one.
    """

    def cell(k: int, b: _Bracket) -> Column:
        x, table = b.values(columns[b.column]), F.lit([float(v) for v in bounds[k]])
        place = F.struct(
            F.lit(k).alias("k"), F.size(F.filter(table, lambda v: v < x)).alias("place"),
            F.array_contains(table, x).alias("equal"),
        )
        return F.when(x.isNotNull(), place)

    cells = [cell(k, b) for k, b in enumerate(brackets)]
    counted = (
        df.select(F.explode(F.array_compact(F.array(*cells))).alias("v")).select("v.*")
        .groupBy("k", "place", "equal").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    n = {(r["k"], r["place"], r["equal"]): r["n"] for r in counted}
    out = {}
    for k in range(len(brackets)):
        below = 0
        for j, bound in enumerate(bounds[k]):
            below += n.get((k, j, False), 0)
            out[k, "lt", bound] = below
            below += n.get((k, j, True), 0)
            out[k, "le", bound] = below
    return out


def _read_off(
    df: DataFrame,
    columns: dict[str, Column],
    brackets: list[_Bracket],
    limits: dict[str, tuple[float, float]],
    found: dict[str, dict[int, float]],
) -> None:
    cells = df.select(*[b.values(columns[b.column]).alias(str(k)) for k, b in enumerate(brackets)])
    counts = (
        cells.unpivot([], cells.columns, "c", "x")
        .where("x is not null")
        .select(group_number("c"), "x")
        .groupBy("c", "x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    targets = {k: [r - b.below for r in b.ranks] for k, b in enumerate(brackets)}
    ranges = {
        k: tuple(
            limits[b.column][i] if bound is None else bound for i, bound in enumerate((b.low, b.high))
        )
        for k, b in enumerate(brackets)
    }
    for c, x, rank in values_at(counts, targets, ranges).collect():
        b = brackets[c]
        found[b.column][rank + b.below] = x


def group_number(name: str) -> Column:
    """A melted column's number.

    Declared never NULL, and so are the join keys made here: a NULL test inferred for a join would
    give its branch a scan of its own instead of the shuffle the other branches share.
    """
    return F.coalesce(F.col(name).cast("int"), F.lit(-1)).alias(name)


def values_at(
    counts: DataFrame, targets: dict[int, list[int]], limits: dict[int, tuple[float, float]]
) -> DataFrame:
    """(c, x, rank): the value at every wanted rank of group c of a table (c, x, n).

    Equal slices of each group's value range are counted first, and only the slices that hold a
    wanted rank are sorted.  Each group must be small enough to be sorted by one task.
    """
    ranges = {c: _slicing(*limits[c]) for c in targets}
    wanted = _by_group({c: f"array({', '.join(f'{r}L' for r in rs)})" for c, rs in targets.items()})
    low = _by_group({c: f"{start!r}D" for c, (start, _) in ranges.items()})
    scale = _by_group({c: f"{per_unit!r}D" for c, (_, per_unit) in ranges.items()})
    slice_ = F.least(F.lit(SLICES - 1), F.floor((F.col("x") - low) * scale)).cast("int")
    sliced = counts.withColumn("slice", F.coalesce(F.when(scale > 0, slice_), F.lit(0)))

    def hits(end: Column, n: Column) -> Column:
        return F.filter(wanted, lambda r: (r >= end - n) & (r < end))

    upto = Window.partitionBy("c").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    totals = sliced.groupBy("c", "slice").agg(F.sum("n").alias("in_slice"))
    ends = totals.withColumn("slice_end", F.sum("in_slice").over(upto))
    needed = ends.where(F.size(hits(F.col("slice_end"), F.col("in_slice"))) > 0).select(
        "c", "slice", (F.col("slice_end") - F.col("in_slice")).alias("before")
    )
    # At most one slice per wanted rank.
    inner = sliced.join(F.broadcast(needed), ["c", "slice"])
    within = (
        Window.partitionBy("c", "slice").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        inner.withColumn("end", F.col("before") + F.sum("n").over(within))
        .select("c", "x", F.explode(hits(F.col("end"), F.col("n"))).alias("rank"))
    )


def _by_group(literals: dict[int, str]) -> Column:
    """The SQL literal that belongs to the row's group c."""
    return F.expr(f"map({', '.join(f'{c}, {v}' for c, v in literals.items())})[c]")


def _slicing(low: float, high: float) -> tuple[float, float]:
    """Start of the range and slices per unit; 0 slices where equal parts make no sense."""
    width = float(high) - float(low)
    scale = SLICES / width if width > 0 and math.isfinite(width) else 0.0
    return (float(low), scale) if math.isfinite(scale) and scale > 0 else (0.0, 0.0)
