"""Numbers for the rows of each group, in order, also where one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeprofile.llm import shared


def ranked_within(df: DataFrame, group: str, by: list[Column], rank: str, total: str) -> DataFrame:
    """Adds the number of each row in its group, from 0 in the given order, and the group's rows.

    Rows are dealt in ranges of (group, order), so that a large group spreads over many tasks, and
    written with the number of their range, which a lost executor then can't change. Groups may be
    null. Rows of equal order come in any order: give an order that tells all but like rows apart.
    Only (range, group) counts are summed, of which a group has at most as many as there are ranges.
    """
    part, own, before = "__range", "__own", "__before"
    dealt = df.repartitionByRange(F.col(group).asc_nulls_first(), *by)
    dealt = shared.cut(dealt.withColumn(part, F.spark_partition_id()), "ranked")
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(part, group).agg(F.count("*").alias("n")).select(
        F.col(part).alias("__p"), F.col(group).alias("__g"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before),
        F.sum("n").over(Window.partitionBy(group)).alias(total),
    )
    numbered = dealt.withColumn(own, F.row_number().over(Window.partitionBy(part, group).orderBy(*by)))
    same = (F.col(part) == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g"))
    return (
        numbered.join(counts, same)
        .withColumn(rank, F.col(own) + F.col(before) - 1)
        .drop(part, own, before, "__p", "__g")
    )
