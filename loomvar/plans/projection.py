"""The driver's tables as variants, transcripts and annotation tracks: integer arithmetic that Spark and DuckDB share.

Each relation is one SELECT that both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"


def pick(expr: str) -> str:
    return f"substr('ACGT', CAST(1 + ({expr}) % 4 AS INT), 1)"


VARIANTS = f"""
SELECT CAST(1 + l_suppkey % 22 AS VARCHAR(10)) AS chrom, 1 + (l_orderkey * 7919 + l_linenumber * 104729) % 1000000 AS pos,
       1 + (l_orderkey * 7919 + l_linenumber * 104729) % 1000000 + (l_partkey % 5) AS end_pos,
       concat({pick('l_partkey')}, substr('CAGTC', 1, CAST(l_partkey % 5 AS INT))) AS ref,
       concat({pick('l_partkey + 1 + l_orderkey % 3')}, substr('CAGTC', 1, CAST(l_suppkey % 3 AS INT))) AS alt,
       l_orderkey AS vkey, CAST(l_linenumber AS BIGINT) AS line, l_returnflag AS flag
FROM lineitem"""

TRANSCRIPTS = """
SELECT p_partkey AS tx_idx, concat('T', CAST(p_partkey AS VARCHAR(20))) AS transcript_id, CAST(1 + p_partkey % 22 AS VARCHAR(10)) AS chrom,
       1 + (p_partkey * 6151) % 1000000 AS start, 1 + (p_partkey * 6151) % 1000000 + 1000 + p_size * 200 AS end_pos,
       CAST(1 - 2 * (p_partkey % 2) AS BIGINT) AS strand, p_brand AS gene_id, CASE WHEN p_partkey % 7 = 0 THEN 'nonsense_mediated_decay' ELSE p_type END AS biotype, p_partkey % 3 <> 0 AS coding,
       CAST((1000 + p_size * 200 - (1000 + p_size * 200) % 8) / 8 AS BIGINT) AS unit
FROM part"""

EXONS = """
SELECT tx_idx, transcript_id, chrom, strand, start + 2 * k * unit AS exon_start, start + 2 * k * unit + unit - 1 AS exon_end,
       CASE WHEN coding THEN start + CAST(unit / 2 AS BIGINT) ELSE 0 END AS cds_start, CASE WHEN coding THEN start + 6 * unit + CAST(unit / 2 AS BIGINT) ELSE 0 END AS cds_end
FROM transcripts, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) ks"""

REGIONS = """
SELECT CAST(1 + o_custkey % 22 AS VARCHAR(10)) AS chrom, 1 + (o_orderkey * 4001) % 1000000 AS start, 1 + (o_orderkey * 4001) % 1000000 + 50 + o_custkey % 200 AS end_pos,
       o_orderpriority AS name, CAST(o_orderkey % 100 AS DOUBLE) AS value
FROM orders"""


def substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, SUBSTITUTIONS, "lineitem")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a file of one row group is one task, and what is exploded or joined from it would stay there."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def relation(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run one of the SELECTs over base tables, without leaving views in the session."""
    frames = {t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in tables}
    named = re.sub(rf"\bFROM ({'|'.join(tables)})\b", r"FROM {\1}", sql)
    return spark.sql(named.replace("CAST(unit / 2 AS BIGINT)", "CAST(floor(unit / 2) AS BIGINT)"), **frames)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, VARIANTS, "lineitem")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, TRANSCRIPTS, "part")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, REGIONS, "orders")


def with_exons(tx: DataFrame) -> DataFrame:
    """exons array and coding bounds, as column expressions of the same arithmetic."""
    unit = F.col("unit")
    exons = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct((F.col("start") + 2 * k * unit).alias("start"), (F.col("start") + 2 * k * unit + unit - 1).alias("end")))
    half = F.floor(unit / 2).cast("long")
    return tx.withColumns({"exons": exons, "cds_start": F.when(F.col("coding"), F.col("start") + half), "cds_end": F.when(F.col("coding"), F.col("start") + 6 * unit + half)})


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection with all columns of a gene model; there is no reference sequence."""
    return with_exons(transcripts(spark, sf_dir)).drop("unit").withColumns(extra())


def extra() -> dict:
    """What the driver's tables have no counterpart of."""
    return {"version": F.lit(None).cast("int"), "gene_symbol": F.lit(""), "canonical": F.lit(False), "spliced": F.lit(None).cast("string"), "protein_id": F.lit(None).cast("string"), "protein_version": F.lit(None).cast("int"), "cds_phase": F.lit(0), "flags": F.array().cast("array<string>"), "tsl": F.lit(None).cast("long"), "appris": F.lit("")}


#: Substitutions of single bases, one for every row.
SUBSTITUTIONS = f"""
SELECT CAST(1 + l_suppkey % 22 AS VARCHAR(10)) AS chrom, 1 + (l_orderkey * 7919 + l_linenumber * 104729) % 1000000 AS pos, 1 + (l_orderkey * 7919 + l_linenumber * 104729) % 1000000 AS end_pos,
       {pick('l_partkey')} AS ref, {pick('l_partkey + 1 + l_orderkey % 3')} AS alt, l_orderkey AS vkey, CAST(l_linenumber AS BIGINT) AS line
FROM lineitem"""


def base(tx: str, offset: str, first: str, unit: str) -> str:
    """Base of transcript `tx` at the spliced place `offset` (from 0, in its direction); coding bases start at `first`. Some
    transcripts begin with ATG, some have a stop in the middle."""
    return f"""CASE WHEN {tx} % 3 <> 0 AND {offset} BETWEEN {first} AND {first} + 2 THEN substr('ATG', CAST({offset} - {first} + 1 AS INT), 1)
 WHEN {tx} % 4 = 1 AND {offset} BETWEEN {first} + 30 AND {first} + 32 THEN substr('TAA', CAST({offset} - {first} - 29 AS INT), 1)
 ELSE {pick(f'{tx} + {offset} * 5 + ({offset} % 11) * ({offset} % 7) + ({offset} % 13) * {tx}')} END"""


def coded_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gene model with bases, by the same arithmetic."""
    tx = transcripts(spark, sf_dir).withColumn("first_", F.expr("CASE WHEN strand > 0 THEN floor(unit / 2) ELSE unit - 1 - floor(unit / 2) END"))
    tx = tx.withColumn("spliced", F.when(F.col("coding"), F.expr(f"array_join(transform(sequence(0L, 4 * unit - 1), o -> {base('tx_idx', 'o', 'first_', 'unit')}), '')")))
    full = with_exons(tx).drop("unit", "first_")
    return full.withColumns({c: x for c, x in extra().items() if c != "spliced"})


def ctes(*names: str) -> str:
    """WITH text that defines the relations of these names for DuckDB."""
    own = {"variants": VARIANTS, "substitutions": SUBSTITUTIONS, "transcripts": TRANSCRIPTS, "exons": EXONS, "regions": REGIONS}
    return "WITH " + ", ".join(f"{n} AS ({own[n].replace('CAST(unit / 2 AS BIGINT)', 'CAST(floor(unit / 2) AS BIGINT)')})" for n in names)
