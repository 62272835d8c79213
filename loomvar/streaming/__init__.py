"""The same verbs on streams: files of variants as they arrive, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvar.operators.intervals import candidate_pairs
from loomvar.sources.vcf import sites_of, variants_from_sites


def stream_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Variant rows of VCF files that arrive in a folder."""
    return variants_from_sites(sites_of(spark.readStream.text(folder)))


def stream_pairs(variants: DataFrame, transcripts: DataFrame, distance: int = 5000) -> DataFrame:
    """Stream-static candidate join: no state is kept."""
    return candidate_pairs(variants, transcripts, distance)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their values by time window and type; windows close `late` after their end."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
