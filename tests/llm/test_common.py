"""Shared helpers of the training-data operators."""

import time

from pyspark.sql import functions as F

from loomvar.llm.common import forget, stored


def test_stored_lets_shuffle_files_go(spark):
    """The shuffle files of stored tables do not pile up until the driver happens to collect its garbage."""
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().endswith(".data")}
    made, first = [], None
    for k in range(4):
        before = files()
        made.append(stored(spark.range(50_000).repartition(4, "id").groupBy((F.col("id") % 1000).alias("k")).count(), "made"))
        first = first or files() - before
    until = time.time() + 10
    while first & files() and time.time() < until:
        time.sleep(0.2)
    assert first and not first & files() and made[0].count() == 1000
    forget(*made)
