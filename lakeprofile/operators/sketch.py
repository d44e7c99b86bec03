"""Quantile sketches of whole columns, merged in two steps so that no task merges those of all tasks."""

from __future__ import annotations

from collections.abc import Hashable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprofile.functions.columns import chunks

#: Tasks of a scan are dealt into this many groups; a group's sketches are merged, then the groups'.
GROUPS = 256
#: Columns of one scan.
AT_ONCE = 16


def sketches(cells: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, n, sketch) of the values x of each key: at most GROUPS sketches of a key meet in a task."""
    group = (F.spark_partition_id() % GROUPS).alias("__group")
    dealt = cells.where("x is not null").select(*keys, "x", group).groupBy(*keys, "__group")
    each = dealt.agg(F.count("x").alias("n"), F.kll_sketch_agg_double("x", F.lit(size)).alias("s"))
    return each.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("s").alias("sketch"))


def quantiles_of(sketch: str, at: list[float]) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit([float(p) for p in at]))


def sketched_quantiles(
    df: DataFrame, wanted: dict[Hashable, tuple[Column, list[float]]], size: int
) -> dict[Hashable, list[float]]:
    """Quantiles of double-valued expressions, near enough to steer a search; none without a value.

    One scan for AT_ONCE expressions; a task gives one sketch of each."""
    out: dict[Hashable, list[float]] = {}
    for part in chunks(list(wanted.items()), AT_ONCE):
        values = df.select(
            (F.spark_partition_id() % GROUPS).alias("__group"),
            *[x.alias(f"x{i}") for i, (_, (x, _)) in enumerate(part)],
        )
        each = values.groupBy("__group").agg(*[
            f for i in range(len(part))
            for f in (F.count(f"x{i}").alias(f"n{i}"), F.kll_sketch_agg_double(f"x{i}", F.lit(size)).alias(f"s{i}"))
        ])
        merged = each.agg(*[
            f for i in range(len(part))
            for f in (F.sum(f"n{i}").alias(f"n{i}"), F.kll_merge_agg_double(f"s{i}").alias(f"s{i}"))
        ])
        row = merged.select(*[
            F.when(F.col(f"n{i}") > 0, quantiles_of(f"s{i}", at)).alias(f"q{i}") for i, (_, (_, at)) in enumerate(part)
        ]).first()
        out |= {name: list(row[i] or []) for i, (name, _) in enumerate(part)}
    return out
