"""Columns of few values, told from those of many without moving the values of the latter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprofile.functions.columns import aggregate_once

#: Relative deviation of the count that sorts out columns of many values.
DEVIATION = 0.05


def few_values(df: DataFrame, columns: dict[str, Column], most: int) -> dict[str, list | None]:
    """The distinct present values of each expression with at most ``most`` of them, None for others.

    A first scan estimates all counts with registers, one row a task. A value fills one register, so a
    column of at most ``most`` values, of which there are far fewer than registers, is estimated at
    little more than that, and one estimated at over twice as many has more for certain. Only the rest
    is collected, by a distinct whose tasks give at most some ``2 * most`` values of a column.
    """
    if not columns:
        return {}
    registers = (1.106 / DEVIATION) ** 2  # by which Spark sizes the estimate, at least
    if most > registers / 4:
        raise ValueError(f"at most {registers / 4:.0f} values can be told from more")
    estimates = aggregate_once(df, {c: F.approx_count_distinct(x, DEVIATION) for c, x in columns.items()})
    out: dict[str, list | None] = dict.fromkeys(columns)
    few = [c for c in columns if estimates[c] <= 2 * most]
    groups: dict[str, list[str]] = {}  # columns of one type are melted together
    types = dict(df.select(*[columns[c].alias(str(i)) for i, c in enumerate(few)]).dtypes)
    for i, c in enumerate(few):
        groups.setdefault(types[str(i)], []).append(c)
    for part in groups.values():
        out |= {c: [] for c in part}
        cells = F.array(*[F.struct(F.lit(i).alias("c"), columns[c].alias("x")) for i, c in enumerate(part)])
        melted = df.select(F.explode(cells).alias("cell")).select("cell.*").where("x is not null")
        for i, x in melted.distinct().collect():
            out[part[i]].append(x)
    return {c: v if v is None or len(v) <= most else None for c, v in out.items()}
