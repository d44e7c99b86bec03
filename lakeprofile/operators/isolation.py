"""Isolation forest over single numeric columns.

In one dimension a forest's score is a step function of the value.  Spark draws the subsamples and
grows one tree per group; the trees' split points then cut the line into intervals of one score,
and Spark counts the rows in each interval.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES = 100
SAMPLE = 256
SEED = 42


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(values: np.ndarray, rng: np.random.Generator, depth: int, limit: int) -> list[tuple]:
    """Leaves (upper end, path length) of one random tree, from left to right."""
    if depth >= limit or len(values) <= 1 or values[0] == values[-1]:
        return [(math.inf, depth + average_path(len(values)))]
    cut = rng.uniform(values[0], values[-1])
    at = int(np.searchsorted(values, cut, side="right"))
    left = grow(values[:at], rng, depth + 1, limit)
    left[-1] = (cut, left[-1][1])
    return left + grow(values[at:], rng, depth + 1, limit)


def subsamples(
    df: DataFrame, x: Column, rows: int, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED
) -> DataFrame:
    """(tree, x): for every tree up to ``sample`` values drawn without replacement.

    Equal values are counted, and their m copies drawn one by one: into the pool by draws
    (j + u) / m, u a hash of the value, and into the trees by a hash of value and copy.  So a value
    has its share of rows in every tree's sample, and the draw does not depend on how rows are
    stored.  Work after the count does not grow with the table.
    """
    pool = min(rows, 2 * trees * sample)
    copies = df.select(x.alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("m"))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "x"), 11).cast("double") * 2.0**-53
    taken = F.ceil(F.col("m") * F.lit(pool / rows) - unit)  # draws below the pool's share
    taken = F.least(F.greatest(taken, F.lit(0)), F.col("m")).cast("int")
    values = (
        copies.withColumn("taken", taken).where("taken > 0")
        .select("x", F.explode(F.sequence(F.lit(1), "taken")).alias("copy"))
        .withColumn("id", F.xxhash64(F.lit(seed), "x", "copy"))
    )
    keep = min(1.0, 2 * sample / pool)
    draws = (
        values.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("h", F.xxhash64(F.lit(seed), "id", "tree"))
        .where(F.pmod("h", F.lit(1_000_000)) < int(keep * 1_000_000))
    )
    order = Window.partitionBy("tree").orderBy("h", "x", "copy")
    return draws.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample)


def isolated_count(
    df: DataFrame,
    x: Column,
    rows: int,
    contamination: str | float = "auto",
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> int:
    """Rows that a forest of ``trees`` trees over ``sample`` values each finds anomalous.

    'auto' flags scores above 0.5; a share flags that share of the rows with the highest scores.
    """
    size = min(sample, rows)
    limit = math.ceil(math.log2(max(size, 2)))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        leaves = grow(np.sort(group["x"].to_numpy()), rng, 0, limit)
        return pd.DataFrame({"tree": tree, "upto": [u for u, _ in leaves],
                             "path": [d for _, d in leaves]})

    # At most `trees` times `sample` leaves come back.
    leaves = (
        subsamples(df, x, rows, trees, sample, seed).select("tree", "x").groupBy("tree")
        .applyInPandas(build, "tree int, upto double, path double").toPandas()
    )
    cuts = np.unique(leaves["upto"][np.isfinite(leaves["upto"])])
    if len(cuts) == 0:
        return 0
    inside = np.concatenate(([cuts[0] - 1], (cuts[:-1] + cuts[1:]) / 2, [cuts[-1] + 1]))
    path = np.zeros(len(inside))
    grown = leaves.groupby("tree")
    for _, tree in grown:
        tree = tree.sort_values("upto")
        path += tree["path"].to_numpy()[np.searchsorted(tree["upto"].to_numpy(), inside)]
    score = 2.0 ** (-path / len(grown) / average_path(size))

    splits = [-math.inf, *cuts.tolist(), math.inf]
    binned = Bucketizer(splits=splits, inputCol="x", outputCol="b").transform(
        df.select(x.alias("x")).where("x is not null")
    )
    per_bin = np.zeros(len(score), dtype=np.int64)
    for r in binned.groupBy("b").count().collect():  # one row per interval
        per_bin[int(r["b"])] = r["count"]
    if contamination == "auto":
        return int(per_bin[score > 0.5].sum())
    return int(per_bin[score > _score_at(score, per_bin, 1 - float(contamination))].sum())


def _score_at(score: np.ndarray, weight: np.ndarray, p: float) -> float:
    """Linear-interpolated quantile of weighted scores."""
    order = np.argsort(score)
    ends = np.cumsum(weight[order])
    h = (ends[-1] - 1) * p
    low, high = (score[order][np.searchsorted(ends, r, side="right")] for r in
                 (math.floor(h), math.ceil(h)))
    return float(low + (high - low) * (h - math.floor(h)))
