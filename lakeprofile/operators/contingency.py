"""Association of categorical columns from their joint value counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.functions.columns import text_key

Pair = tuple[str, str]


# A column with at most this many values collapses the rows it is counted with.
LABELS = 100
# A table of marginals of at most this many rows is broadcast.
BROADCAST_VALUES = 50_000


def cramers_v(df: DataFrame, pairs: list[Pair], unique: dict[str, int]) -> dict[Pair, float]:
    """Cramér's V without continuity correction of each pair; 0 where it is undefined.

    Chi-square is N(Σ n_ij² / (n_i n_j) - 1), so empty cells are never made.  Label-like columns are
    counted together first, and their pairs are made from that small table.  Only the marginals of
    the column with fewer values are joined back to the cells; the other marginal is a plain sum,
    so no task gathers the cells of a frequent value.
    """
    if not pairs:
        return {}
    turned = [(a, b) if unique[a] >= unique[b] else (b, a) for a, b in pairs]
    place = {c: f"k{i}" for i, c in enumerate(sorted({c for pair in turned for c in pair}))}
    keys = df.select(*[text_key(df, c).alias(k) for c, k in place.items()])
    labels = [k for c, k in place.items() if unique[c] <= LABELS]

    def cells_of(rows: DataFrame, chosen: list[int]) -> DataFrame:
        made = F.array(*[
            F.struct(F.lit(k).alias("pair"), F.col(place[turned[k][0]]).alias("a"),
                     F.col(place[turned[k][1]]).alias("b"))
            for k in chosen
        ])
        cells = rows.select("n", F.explode(made).alias("cell")).select("cell.*", "n")
        return cells.where("a is not null and b is not null")

    few = [k for k, (a, b) in enumerate(turned) if place[a] in labels and place[b] in labels]
    many = [k for k in range(len(turned)) if k not in few]
    parts = []
    if few:
        collapsed = keys.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))
        parts.append(cells_of(collapsed, few))
    if many:
        parts.append(cells_of(keys.withColumn("n", F.lit(1).cast("bigint")), many))
    cells = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    cells = cells.groupBy("pair", "a", "b").agg(F.sum("n").alias("n"))
    columns = cells.groupBy("pair", "b").agg(F.sum("n").alias("n_b"))
    marginals = columns
    if sum(unique[b] for _, b in turned) <= BROADCAST_VALUES:
        marginals = F.broadcast(columns)
    rows = (
        cells.join(marginals, ["pair", "b"])
        .groupBy("pair", "a")
        .agg(F.sum("n").alias("n_a"), F.sum(F.col("n") * F.col("n") / F.col("n_b")).alias("s"))
    )
    by_row = rows.groupBy("pair").agg(
        F.sum("n_a").alias("n"), F.count(F.lit(1)).alias("values_a"),
        F.sum(F.col("s") / F.col("n_a")).alias("s"),
    )
    # The sum keeps this branch on the marginals' shuffle instead of a scan of its own.
    by_column = columns.groupBy("pair").agg(
        F.count(F.lit(1)).alias("values_b"), F.sum("n_b").alias("total")
    )
    out = dict.fromkeys(pairs, 0.0)
    for r in by_row.join(by_column, "pair").collect():
        k = min(r["values_a"], r["values_b"]) - 1
        if k > 0:
            out[pairs[r["pair"]]] = math.sqrt(max(0.0, r["s"] - 1) / k)
    return out
