"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def own_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='loomvar-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of the session; without one, a temporary folder if they are one
    process, else the warehouse."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    told = found.get() if found.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    if sc.master == "local" or sc.master.startswith("local["):
        return own_dir(sc.applicationId)
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/loomvar-scratch"


def few(spark: SparkSession) -> int:
    """Files of a table that is small beside its input: a sixteenth of the shuffle partitions, 8 at least."""
    return max(8, partitions(spark) // 16)


def gathered(df: DataFrame) -> DataFrame:
    """df, small beside its input, in few files: computed at its full width, then dealt out evenly."""
    return df.repartition(few(df.sparkSession))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches, which Spark bounds by bytes, in slices of at most BATCH_ROWS rows, so that what is made of them is small too."""
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(k, BATCH_ROWS)


def give_back() -> None:
    """Return to the system what this process has freed: Python workers stay, idle, beside the JVM's next stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with its memory given back at the end of each task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def few_rows(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A frame of rows that the driver holds, sent as Arrow: of tuples, Spark makes an RDD that starts Python workers of its own
    on each executor, which stay beside the others."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(","))])
    return spark.createDataFrame(pa.table(columns, schema=fields), schema)


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def release(spark: SparkSession) -> None:
    """Let shuffle files go that nothing will read again: Spark deletes them when the driver collects its garbage, which at a
    few actions over much data it need not do before the disk is full."""
    gc.collect()  # frames that only Python holds
    spark.sql("SELECT 1").collect()  # the threads of the listener bus hold the last event that they saw, and with it a plan
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back. The table goes with `forget`, or when
    the driver ends; the shuffle files of its making go before the next one is made, at the latest."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    release(spark)
    df.write.parquet(path)
    where, fs = _path(spark, path)
    fs.deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back.loomvar_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again: all that was made of them is stored itself."""
    for t in tables:
        where, fs = _path(t.sparkSession, t.loomvar_path)
        fs.delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    """A-Z to a-z; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
