"""Gene models from GFF3: transcripts with their exons and coding ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvar.functions.alleles import revcomp
from loomvar.sources.fasta import slices
from loomvar.sources.text import lines


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """seqid, source, type, start, end, score, strand, phase, attributes (a map)."""
    f = lambda k: F.get("c", F.lit(k))
    rows = lines(spark, path).where("value <> '' and not startswith(value, '#')").select(F.split("value", "\t", -1).alias("c")).where(F.size("c") >= 9)
    pairs = F.filter(F.split(f(8), ";"), lambda x: F.contains(x, F.lit("=")))
    entry = lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.try_url_decode(F.regexp_replace(F.substr(x, F.instr(x, "=") + 1), r"\+", "%2B")).alias("v"))
    once = F.aggregate(F.transform(pairs, entry), F.create_map().cast("map<string,string>"), lambda m, e: F.when(F.map_contains_key(m, e["k"]), m).otherwise(F.map_concat(m, F.create_map(e["k"], e["v"]))))
    return rows.select(f(0).alias("seqid"), f(1).alias("source"), f(2).alias("type"), f(3).cast("long").alias("start"), f(4).cast("long").alias("end"), f(5).alias("score"), f(6).alias("strand"), f(7).alias("phase"), once.alias("attributes"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end_pos, name, value of a BED file; 1-based and closed."""
    f = lambda k: F.get("c", F.lit(k))
    rows = lines(spark, path).where("value <> '' and not startswith(value, '#') and not startswith(value, 'track') and not startswith(value, 'browser')").select(F.split("value", "\t", -1).alias("c"))
    return rows.select(f(0).alias("chrom"), (f(1).cast("long") + 1).alias("start"), f(2).cast("long").alias("end_pos"), f(3).alias("name"), f(4).try_cast("double").alias("value"))


def gene_model(rows: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One row per transcript, in the order (chrom, start, transcript_id): the columns of a transcript table, exons, coding
    bounds, protein id, and, with reference sequence, the spliced bases in the transcript's direction.

    A transcript that is listed twice counts once. `canonical` is the tag Ensembl_canonical."""
    a = F.col("attributes")
    bare = lambda x: F.regexp_replace(x, "^(gene|transcript|CDS):", "")
    genes = rows.where("startswith(attributes['ID'], 'gene:')").select(bare(a["ID"]).alias("gene_id"), F.coalesce(a["Name"], F.lit("")).alias("gene_symbol")).dropDuplicates(["gene_id"])
    tags = F.when(a["tag"].isNull(), F.array().cast("array<string>")).otherwise(F.split(a["tag"], ","))
    txs = rows.where("startswith(attributes['ID'], 'transcript:')").select(
        bare(a["ID"]).alias("transcript_id"),
        a["version"].try_cast("int").alias("version"),
        F.col("seqid").alias("chrom"),
        "start",
        F.col("end").alias("end_pos"),
        F.when(F.col("strand") == "-", -1).otherwise(1).cast("long").alias("strand"),
        F.coalesce(a["biotype"], F.lit("")).alias("biotype"),
        bare(F.coalesce(a["Parent"], F.lit(""))).alias("gene_id"),
        F.array_contains(tags, "Ensembl_canonical").alias("canonical"),
        F.regexp_extract(a["transcript_support_level"], r"^(\d+)", 1).try_cast("long").alias("tsl"),
        F.coalesce(F.get(F.filter(tags, lambda t: t.startswith("appris")), F.lit(0)), F.lit("")).alias("appris"),
        tags.alias("flags"),
    ).dropDuplicates(["transcript_id"])
    parts = rows.where("type in ('exon', 'CDS') and attributes['Parent'] is not null").withColumn("transcript_id", F.explode(F.split(a["Parent"], ","))).withColumn("transcript_id", bare(F.col("transcript_id")))
    # the parts of one transcript: bounded by its number of exons
    exons = parts.where("type = 'exon'").groupBy("transcript_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("exons"))
    coding = parts.where("type = 'CDS'").groupBy("transcript_id").agg(
        F.min("start").alias("cds_start"), F.max("end").alias("cds_end"), F.max(bare(F.coalesce(a["protein_id"], a["ID"]))).alias("protein_id"), F.max(a["version"].try_cast("int")).alias("protein_version"),
        F.min_by(F.col("phase").try_cast("int"), "start").alias("first_phase"), F.max_by(F.col("phase").try_cast("int"), "start").alias("last_phase"),
    )
    none = F.array().cast("array<struct<start:long,end:long>>")
    made = txs.join(genes, "gene_id", "left").join(exons, "transcript_id", "left").join(coding, "transcript_id", "left")
    made = made.withColumn("exons", F.coalesce("exons", none)).withColumn("coding", F.col("cds_start").isNotNull()).withColumn("gene_symbol", F.coalesce("gene_symbol", F.lit("")))
    made = made.withColumn("cds_phase", F.coalesce(F.when(F.col("strand") > 0, F.col("first_phase")).otherwise(F.col("last_phase")), F.lit(0))).drop("first_phase", "last_phase")
    if chunks is None:
        return made.withColumn("spliced", F.lit(None).cast("string"))
    ranges = made.select("transcript_id", "chrom", F.explode("exons").alias("x")).select("transcript_id", "chrom", "x.start", "x.end")
    pieces = slices(ranges, chunks, ["transcript_id"]).groupBy("transcript_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "bases"))), lambda x: x["bases"]), "").alias("spliced"), F.count("*").alias("pieces"))
    made = made.join(pieces, "transcript_id", "left")
    whole = F.col("pieces") == F.size("exons")
    return made.withColumn("spliced", F.when(whole, F.when(F.col("strand") > 0, F.col("spliced")).otherwise(revcomp(F.col("spliced"))))).drop("pieces")


def read_gff_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """The 13 import columns of a gene model."""
    return gene_model(read_gff(spark, path)).select("transcript_id", "chrom", "start", "end_pos", "strand", "biotype", "gene_id", "gene_symbol", "canonical", "coding", "tsl", "appris", "flags")
