"""The gene model of a session: tables, a Parquet cache, views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomvar.sources.fasta import read_fasta
from loomvar.sources.gff import gene_model, read_gff
from loomvar.sources.text import head, modified


@dataclass
class GeneModel:
    """Transcripts with nested exons, and how far from a transcript a variant still counts."""

    table: DataFrame
    distance: int = 5000

    @staticmethod
    def load(spark: SparkSession, path: str, fasta: str | None = None, distance: int = 5000, zstd: int = 3, cache: str | None = None) -> GeneModel:
        """From GFF3 (plain or gzip) or from a cache that `save` wrote; told apart by content.

        With `cache`, a GFF3 model is written there, and read from there while it is newer than the GFF3 file."""
        distance = max(distance, 0)
        if GeneModel.is_cache(spark, path):
            return GeneModel(spark.read.parquet(path), distance)
        if cache:
            written = modified(spark, f"{cache}/_SUCCESS")
            if written is None or written < modified(spark, path):
                GeneModel.parsed(spark, path, fasta, distance).save(cache, zstd)
            return GeneModel(spark.read.parquet(cache), distance)
        return GeneModel.parsed(spark, path, fasta, distance)

    @staticmethod
    def is_cache(spark: SparkSession, path: str) -> bool:
        return modified(spark, f"{path}/_SUCCESS") is not None or head(spark, path) == b"PAR1"

    @staticmethod
    def parsed(spark: SparkSession, path: str, fasta: str | None, distance: int) -> GeneModel:
        made = gene_model(read_gff(spark, path), read_fasta(spark, fasta) if fasta else None)
        # one small dimension: ordinals by (chrom, start, id) need its total order; counts of chromosomes give the offsets
        sizes = made.groupBy("chrom").agg(F.count("*").alias("n"))
        base = sizes.select("chrom", F.coalesce(F.sum("n").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        ranked = made.join(base, "chrom").withColumn("tx_idx", F.row_number().over(Window.partitionBy("chrom").orderBy("start", "transcript_id")) - 1 + F.col("base"))
        return GeneModel(ranked.drop("base"), distance)

    def save(self, path: str, zstd: int = 3) -> None:
        """Parquet, sorted by (chrom, start, transcript_id) so that row groups can be pruned, zstd."""
        level = min(max(zstd, 1), 22)
        rows = self.table.repartitionByRange("chrom", "start", "transcript_id").sortWithinPartitions("chrom", "start", "transcript_id")
        rows.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.block.size", 8 << 20).parquet(path)

    def transcripts(self) -> DataFrame:
        return self.table.select("transcript_id", "chrom", "start", "end_pos", "strand", "gene_id", "gene_symbol", "biotype", "canonical", "coding")

    def exons(self) -> DataFrame:
        """Exons with strand and coding bounds; 0 where a transcript is not coding."""
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        return self.table.select("tx_idx", "chrom", F.explode("exons").alias("x"), "strand", zero("cds_start"), zero("cds_end")).select("tx_idx", "chrom", F.col("x.start").alias("exon_start"), F.col("x.end").alias("exon_end"), "strand", "cds_start", "cds_end")

    def cds_seq(self) -> DataFrame:
        """(tx_idx, cds_seq) of coding transcripts whose bases are known."""
        inside = lambda lo, hi: F.aggregate("exons", F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.least(x["end"], hi) - F.greatest(x["start"], lo) + 1, F.lit(0).cast("long")))
        before = F.when(F.col("strand") > 0, inside(F.lit(0), F.col("cds_start") - 1)).otherwise(inside(F.col("cds_end") + 1, F.lit(1 << 62)))
        rows = self.table.where("coding and spliced is not null")
        return rows.select("tx_idx", F.substr("spliced", (before + 1).cast("int"), inside(F.col("cds_start"), F.col("cds_end")).cast("int")).alias("cds_seq"))

    def register(self, spark: SparkSession) -> str:
        """Temporary views vep_transcripts, vep_exons, vep_cds_seq."""
        self.transcripts().createOrReplaceTempView("vep_transcripts")
        self.exons().createOrReplaceTempView("vep_exons")
        self.cds_seq().createOrReplaceTempView("vep_cds_seq")
        return "loaded"
