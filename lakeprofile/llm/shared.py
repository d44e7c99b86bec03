"""Tables written to the shared folder of the cluster, to cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

SETTING = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it is unset, as in tests, a local session gets one of its own; on a cluster this raises,
    since a folder of one machine is of no use to the others.
    """
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError(f"set {SETTING} to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="shared-")
    spark.conf.set(SETTING, made)
    return made


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in whatever file system it names."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, sorted; none where it is missing."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def parts(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for so many rows of which one task takes about `each`; never below the setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Words of a text column, as runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, by: list[Column], name: str = "rank") -> DataFrame:
    """Numbers the rows from 0 in an order that has no ties, without sorting them in one task."""
    parts, own, before = "__part", "__own", "__before"
    dealt = df.repartitionByRange(*by).withColumn(parts, F.spark_partition_id())
    dealt = cut(dealt, "ranked")
    # One row per partition, whatever the number of rows.
    ends = Window.orderBy(parts).rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(parts).agg(F.count("*").alias("n")).select(
        parts, F.coalesce(F.sum("n").over(ends), F.lit(0)).alias(before)
    )
    order = F.row_number().over(Window.partitionBy(parts).orderBy(*by))
    return (
        dealt.withColumn(own, order)
        .join(offsets, parts)
        .withColumn(name, (F.col(own) + F.col(before) - 1).cast("long"))
        .drop(parts, own, before)
    )


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, to bound what a task holds beside them."""
    for batch in batches:
        for i in range(0, max(1, len(batch)), rows):
            yield batch.slice(i, rows)


def packed(docs: DataFrame, text: str) -> DataFrame:
    """The same rows with one text column compressed, to halve what a shuffle moves of them."""
    place = docs.columns.index(text)
    fields = [StructField(text, BinaryType()) if f.name == text else f for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches):
            z = [None if t is None else pack.compress(t.encode()) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, text, pa.array(z, pa.binary()))

    return docs.mapInArrow(run, StructType(fields))


def unpacked(docs: DataFrame, text: str, schema: StructType) -> DataFrame:
    """The rows that `packed` packed; `schema` is that of the rows wanted."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in sliced(batches):
            texts = [None if z is None else unpack.decompress(z).decode() for z in batch.column(place).to_pylist()]
            yield batch.set_column(place, text, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, schema)


def packed_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, z): the texts compressed one by one, to halve what a shuffle moves; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches):
            z = [pack.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], [key, "z"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, z binary")
