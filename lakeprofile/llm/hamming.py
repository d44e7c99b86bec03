"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code has a bit for each of its numbers, set where that is above 0. Codes are dealt into
shards of at most about EACH by a hash of their id; a shard keeps, for every segment of 16 bits, a table of
the codes by the value of that segment. Every query visits every shard: it looks up its own segment
values, then those that differ in one bit, in two, and so on. After radius r in all m segments each
code within m * (r + 1) - 1 bits has been met, since one of its segments must be within r; when the
k-th best verified distance is within that bound, the shard's top k are proven and it stops. The k
best of all shards are the result, exact and with ties broken by the smaller id.

Defined results: null and empty vectors have no code: they are neither queries nor results; null
and NaN count as not above 0; only codes of equal length are compared; rows that agree in id and
code are one; a query never finds its own row, but other rows of its id, if they differ. Where there
are fewer than k others, all of them are returned. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeprofile.llm import shared

TOP = 10
EACH = 50_000
SEGMENT = 16

_MASKS: dict[int, np.ndarray] = {}


def _masks(radius: int) -> np.ndarray:
    """Every 16-bit value with so many bits set."""
    if radius not in _MASKS:
        chosen = combinations(range(SEGMENT), radius)
        _MASKS[radius] = np.array([sum(1 << i for i in c) for c in chosen], np.int64)
    return _MASKS[radius]


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(1)
        keep = pa.compute.greater(pa.compute.fill_null(pa.compute.list_value_length(values), 0), 0)
        ids, values = batch.column(0).filter(keep), values.filter(keep)
        size = pa.compute.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64) > 0
        ends = np.cumsum(size)
        codes = []
        for a, b in zip((ends - size).tolist(), ends.tolist()):
            bits = np.zeros(-(-(b - a) // 64) * 64, bool)
            bits[: b - a] = flat[a:b]
            codes.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(size.astype(np.int32)), pa.array(codes, pa.binary())], ["vec_id", "bits", "code"]
        )


class Index:
    """The codes of a shard with a table for each segment."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes  # rows of 64-bit words
        parts = codes.view(np.uint16)
        self.segments = parts.shape[1]
        self.order, self.begin = [], []
        for s in range(self.segments):
            own = parts[:, s].astype(np.int64)
            self.order.append(np.argsort(own, kind="stable"))
            self.begin.append(np.concatenate(([0], np.cumsum(np.bincount(own, minlength=1 << SEGMENT)))))

    def search(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of all codes that are not farther than the k-th best."""
        own = code.view(np.uint16).astype(np.int64)
        met = np.zeros(len(self.codes), bool)
        found, apart = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for radius in range(SEGMENT + 1):
            for s in range(self.segments):
                values = own[s] ^ _masks(radius)
                low, high = self.begin[s][values], self.begin[s][values + 1]
                many = high - low
                total = int(many.sum())
                if not total:
                    continue
                at = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(total)
                new = self.order[s][at]
                new = new[~met[new]]
                met[new] = True
                found = np.concatenate((found, new))
                apart = np.concatenate((apart, np.bitwise_count(self.codes[new] ^ code).sum(1).astype(np.int64)))
            covered = self.segments * (radius + 1) - 1
            if len(found) == len(self.codes):
                break
            if len(found) >= k and np.partition(apart, k - 1)[k - 1] <= covered:
                break
        if len(found) > k:
            near = apart <= np.partition(apart, k - 1)[k - 1]
            found, apart = found[near], apart[near]
        return found, apart


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, index = None, [], None
        for batch in batches:
            shard, bits, query, ids, codes = (batch.column(i).to_pylist() for i in range(5))
            out = []
            for i, code in enumerate(codes):
                if key != (shard[i], bits[i]):
                    key, rows, index = (shard[i], bits[i]), [], None
                if not query[i]:
                    rows.append((ids[i], code))
                    continue
                if not rows:
                    continue
                if index is None:
                    data = b"".join(c for _, c in rows)
                    index = Index(np.frombuffer(data, np.uint64).reshape(len(rows), -1))
                found, apart = index.search(np.frombuffer(code, np.uint64), k + 1)
                best = sorted(
                    (d, rows[j][0])
                    for j, d in zip(found.tolist(), apart.tolist())
                    if rows[j] != (ids[i], code)
                )[:k]
                out += [(ids[i], code, other, d) for d, other in best]
            kind = batch.schema.field(3).type
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[j] for o in out], t) for j, t in enumerate((kind, pa.binary(), kind, pa.int32()))],
                ["query_id", "code", "vec_id", "distance"],
            )

    return run


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = TOP,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    each: int = EACH,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, distance: the k nearest vectors of every query, which have
    the columns of `vectors`."""

    def coded(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("v"))
        rows = rows.where(F.col("vec_id").isNotNull())
        kind = rows.schema["vec_id"].dataType.simpleString()
        return rows.mapInArrow(_codes, f"vec_id {kind}, bits int, code binary").distinct()

    index = shared.cut(coded(vectors), "codes")
    kind = index.schema["vec_id"].dataType.simpleString()
    shards = shared.parts(vectors.sparkSession, index.count(), each)
    dealt = index.select(
        F.pmod(F.xxhash64("vec_id", "code"), F.lit(shards)).cast("int").alias("shard"), "bits",
        F.lit(False).alias("query"), "vec_id", "code",
    )
    asked = coded(queries).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "bits",
        F.lit(True).alias("query"), "vec_id", "code",
    )
    found = (
        dealt.unionByName(asked)
        .repartition(shards, "shard", "bits")
        .sortWithinPartitions("shard", "bits", "query")
        .mapInArrow(_searched(k), f"query_id {kind}, code binary, vec_id {kind}, distance int")
    )
    best = Window.partitionBy("query_id", "code").orderBy("distance", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "distance")


def oracle(k: int = TOP) -> str:
    return f"""
with q as (select vec_id query_id, embedding a from embeddings where vec_id % 100 = 0),
d as (
  select query_id, vec_id,
         list_sum(list_transform(list_zip(a, embedding),
           lambda p: case when (p[1] > 0) <> (p[2] > 0) then 1 else 0 end))::integer distance
  from q, embeddings where vec_id <> query_id),
r as (
  select *, row_number() over (partition by query_id order by distance, vec_id)::integer "rank"
  from d)
select query_id, "rank", vec_id, distance from r where "rank" <= {k}
"""
