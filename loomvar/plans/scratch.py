"""A folder for files that a query writes and reads again."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def own_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='loomvar-')}"


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; it goes when the driver ends."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    shared = found.get() if found.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = own_dir(sc.applicationId) if sc.master == "local" or sc.master.startswith("local[") else f"{spark.conf.get('spark.sql.warehouse.dir')}/loomvar-scratch"
    path = f"{shared}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
