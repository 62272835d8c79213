"""Text lines of plain or gzip files, told apart by their first bytes."""

from __future__ import annotations

import gzip
import io
import itertools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def head(spark: SparkSession, path: str, n: int = 4) -> bytes:
    """The first bytes of a file, read through Spark's file system layer; none of a folder."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(where).isDirectory():
        return b""
    stream = fs.open(where)
    try:
        got = [stream.read() for _ in range(n)]
        return bytes(b for b in got if b >= 0)
    finally:
        stream.close()


def modified(spark: SparkSession, path: str) -> int | None:
    """Modification time in ms, None if there is no such path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(where).getModificationTime() if fs.exists(where) else None


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One column `value`, of a file or of the files in a folder. A file with gzip content and another ending than .gz is
    unpacked as a stream by one task."""
    if path.endswith(".gz") or head(spark, path, 2) != b"\x1f\x8b":
        return spark.read.text(path)

    def unpack(frames):
        for frame in frames:
            for content in frame["content"]:
                with io.TextIOWrapper(gzip.GzipFile(fileobj=io.BytesIO(content)), "utf-8", "replace", newline="\n") as stream:
                    while rows := [x.rstrip("\r\n") for x in itertools.islice(stream, 10_000)]:
                        yield pd.DataFrame({"value": rows})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "value string")
