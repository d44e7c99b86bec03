"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm import shared


def _least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the smallest node next to u, u included; partial minima in each task,
    so that a node with many edges costs no more, and a join that Spark may split."""
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    return edges.join(least, F.col("u") == F.col("w")).select(
        "u", "v", F.least("u", "m").alias("m")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _least(down)
    moved = found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(found.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of a table of edges (u, v).

    Edges may repeat, point either way or lead back to their node. Each round is written to the
    shared folder; rounds grow with the logarithm of the number of nodes. Nodes without an edge to
    another node have no row.
    """
    edges = shared.cut(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
        edges = shared.cut(_small_star(_large_star(edges)), "edges")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
