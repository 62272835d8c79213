"""Variant files (VCF text, plain or gzip) as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvar.functions.alleles import compute_end, in_region
from loomvar.sources.text import lines

SITE = "chrom string, pos long, end_pos long, id string, ref string, alt array<string>, qual double, filter array<string>, info string, gt array<string>"


def listed(field, sep: str):
    """A list field; empty for `.` and for nothing."""
    empty = F.array().cast("array<string>")
    return F.when(field.isNull() | field.isin(".", ""), empty).otherwise(F.split(field, sep, -1))


def genotypes(cols):
    """GT strings by sample, as written; `.` where a sample or FORMAT has none; empty without FORMAT."""
    at = F.array_position(F.split(F.get(cols, F.lit(8)), ":", -1), F.lit("GT"))
    samples = F.slice(cols, 10, F.greatest(F.size(cols) - 9, F.lit(0)))
    return F.when(F.size(cols) < 10, F.array().cast("array<string>")).otherwise(
        F.transform(samples, lambda s: F.when(at > 0, F.coalesce(F.get(F.split(s, ":", -1), (at - 1).cast("int")), F.lit("."))).otherwise("."))
    )


def sites_of(text: DataFrame) -> DataFrame:
    """SITE rows of lines in `value`; lines without a position are left out, a position that is no number is an error."""
    field = lambda k: F.get("c", F.lit(k))
    number = lambda k, kind: F.when(~field(0).startswith("#"), field(k).cast(kind))  # noqa: E731  the planner may cast before it drops header lines
    rows = text.where("value <> '' and not startswith(value, '#')").select(F.split("value", "\t", -1).alias("c"))
    rows = rows.where(field(1).isNotNull() & ~field(1).isin("", ".", "0"))
    rows = rows.select(field(0).alias("chrom"), number(1, "long").alias("pos"), field(2).alias("id"), field(3).alias("ref"), listed(field(4), ",").alias("alt"), F.when(field(5) != ".", number(5, "double")).alias("qual"), listed(field(6), ";").alias("filter"), F.coalesce(field(7), F.lit("")).alias("info"), genotypes(F.col("c")).alias("gt"))
    return rows.select("chrom", "pos", compute_end(F.col("pos"), F.col("ref"), F.col("info")).alias("end_pos"), "id", "ref", "alt", "qual", "filter", "info", "gt")


def read_vcf(spark: SparkSession, path: str, region: str | None = None) -> DataFrame:
    """One row per record; with `region` those whose span overlaps it."""
    sites = sites_of(lines(spark, path))
    return sites if region is None else sites.where(in_region(region, F.col("chrom"), F.col("pos"), F.col("end_pos")))


def vcf_samples(spark: SparkSession, path: str) -> DataFrame:
    """(idx, sample) in header order, from 1."""
    header = lines(spark, path).where("startswith(value, '#CHROM')").select(F.split("value", "\t", -1).alias("c"))
    return header.select(F.posexplode(F.slice("c", 10, F.greatest(F.size("c") - 9, F.lit(0)))).alias("k", "sample")).select((F.col("k") + 1).cast("long").alias("idx"), "sample")


def variants_from_sites(sites: DataFrame) -> DataFrame:
    """One row per ALT: chrom, pos, end_pos, ref, alt."""
    return sites.select("chrom", "pos", "end_pos", "ref", F.explode("alt").alias("alt"))


def variants_from_vcf(spark: SparkSession, path: str, region: str | None = None) -> DataFrame:
    return variants_from_sites(read_vcf(spark, path, region))


def sample_genotypes(sites: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per site and sample, by the sample's ordinal: site columns, idx, sample, gt."""
    each = sites.select("chrom", "pos", "end_pos", "ref", "alt", F.posexplode("gt").alias("k", "gt")).withColumn("idx", (F.col("k") + 1).cast("long")).drop("k")
    return each.join(samples, "idx")


def phased_variants(sites: DataFrame, samples: DataFrame) -> DataFrame:
    """Variant rows with sample_id, phase_set and haplotype of fully phased genotypes; haplotypes from 1."""
    each = sample_genotypes(sites, samples).where(F.col("gt").contains("|"))
    called = each.select("chrom", "pos", "end_pos", "ref", "alt", F.col("sample").alias("sample_id"), F.posexplode(F.split("gt", r"\|")).alias("h", "allele"))
    allele = F.col("allele").try_cast("int")
    return called.where(allele > 0).select("chrom", "pos", "end_pos", "ref", F.get("alt", allele - 1).alias("alt"), "sample_id", F.lit("1").alias("phase_set"), (F.col("h") + 1).alias("haplotype")).where("alt is not null")
