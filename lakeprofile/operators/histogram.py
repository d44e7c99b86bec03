"""Equal-width histograms by plain grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprofile.functions.columns import col


def linear_edges(low: float, high: float, bins: int) -> list[float]:
    """Bin edges; a single value gets a unit-wide range around it."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    return sorted({*(low + k * step for k in range(bins)), high})


def _bin(x: Column, edges: list[float]) -> Column:
    """Number of the bin of equal width that holds x, set right against the edges themselves."""
    last = len(edges) - 2
    if last <= 0:
        return F.lit(0)
    low, width = edges[0], (edges[-1] - edges[0]) / (last + 1)
    guess = F.least(F.lit(last), F.greatest(F.lit(0), F.floor((x - F.lit(low)) / F.lit(width)).cast("int")))
    table = F.lit([float(e) for e in edges])
    return (
        F.when(x < F.get(table, guess), guess - 1)
        .when((guess < last) & (x >= F.get(table, guess + 1)), guess + 1)
        .otherwise(guess)
    )


def with_bins(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Add column b_<name> with the 0-based bin of each double column; NULL for a missing value.

    Bins are of equal width, closed on the left, the last one on both sides; every value must lie in
    the range.  Where rounding has merged edges, the edges are counted instead.
    """

    def number(c: str, e: list[float]) -> Column:
        even = len(e) < 3 or min(b - a for a, b in zip(e, e[1:])) > 0.5 * (e[-1] - e[0]) / (len(e) - 1)
        if even:
            return _bin(col(c), e)
        inner = F.lit([float(v) for v in e[1:-1]])
        return F.size(F.filter(inner, lambda v: v <= col(c)))

    return df.withColumns({
        f"b_{c}": F.when(col(c).isNotNull(), number(c, e)).cast("bigint") for c, e in edges.items()
    })


def histogram_counts(
    df: DataFrame,
    columns: dict[str, tuple[Column, list[float]]],
    weights: dict[str, Column] | None = None,
    keys: list[Column] = (),
) -> DataFrame:
    """(key0..., column, bin, one count per weight): all columns in one shuffle of bin counts."""
    weights = weights or {"count": F.lit(1)}
    names = [f"key{k}" for k in range(len(keys))]
    if not columns:
        found = [F.lit(None).cast("string").alias(n) for n in [*names, "column"]]
        found += [F.lit(0).cast("bigint").alias(n) for n in ("bin", *weights)]
        return df.select(*found).where(F.lit(False))
    data = df.select(
        *[k.alias(n) for k, n in zip(keys, names, strict=True)],
        *[w.alias(f"w_{n}") for n, w in weights.items()],
        *[x.alias(str(k)) for k, (x, _) in enumerate(columns.values())],
    )
    binned = with_bins(data, {str(k): e for k, (_, e) in enumerate(columns.values())})
    kept = [*names, *[f"w_{n}" for n in weights]]
    bins = [F.col(f"b_{k}").alias(c) for k, c in enumerate(columns)]
    return (
        binned.select(*kept, *bins)
        .unpivot(kept, [col(c) for c in columns], "column", "bin")
        .where("bin is not null")
        .groupBy(*names, "column", "bin")
        .agg(*[F.sum(f"w_{n}").alias(n) for n in weights])
    )


def edge_table(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(column, bin, low, high) of every bin, so that empty bins can be shown."""
    rows = [
        (c, k, float(e[k]), float(e[k + 1])) for c, e in edges.items() for k in range(len(e) - 1)
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, bin bigint, low double, high double"
    )
