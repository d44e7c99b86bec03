"""Small files on any file system that Spark itself reaches.

A path without a scheme is one of the session's default file system, as in Spark's readers.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("files are reached through a Spark session, and none is active")
    return spark


def read_text(path: str, spark: SparkSession | None = None) -> str:
    spark = spark or _session()
    rows = spark.read.format("binaryFile").load(path).select("content").collect()  # one small file
    return bytes(rows[0]["content"]).decode("utf-8")


def write_text(path: str, text: str, spark: SparkSession | None = None) -> None:
    """Write a file, replacing one that is there; parents are made."""
    system, at = _at(spark or _session(), path)
    out = system.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def list_files(
    directory: str, extensions: tuple[str, ...], spark: SparkSession | None = None
) -> list[str]:
    """Paths directly inside a directory with one of the extensions, in order."""
    system, at = _at(spark or _session(), directory)
    if not system.exists(at) or not system.getFileStatus(at).isDirectory():
        raise NotADirectoryError(directory)
    base = directory.rstrip("/")
    found = [s.getPath().getName() for s in system.listStatus(at)]
    return sorted(f"{base}/{name}" for name in found if name.lower().endswith(extensions))
