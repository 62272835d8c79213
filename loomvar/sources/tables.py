"""Table dumps, line-delimited JSON and literal rows as sources; files and saved tables as sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvar.sources.text import lines

NUMBER = re.compile(r"^(big|small|tiny|medium)?int|^serial", re.I)


def ddl_columns(text: str) -> dict[str, list[tuple[str, str]]]:
    """Tables of CREATE TABLE statements: name to (column, Spark type)."""
    out = {}
    for name, body in re.findall(r"CREATE TABLE\s+(?:IF NOT EXISTS\s+)?[`\"]?(\w+)[`\"]?\s*\((.*?)\n\)", text, re.S | re.I):
        cols = []
        for line in body.splitlines():
            m = re.match(r"\s*[`\"](\w+)[`\"]\s+(\w+)|\s*(\w+)\s+(\w+)", line)
            word = (m[1] or m[3] or "").upper() if m else ""
            if m and (m[1] or word not in ("PRIMARY", "KEY", "UNIQUE", "CONSTRAINT", "FULLTEXT", "INDEX", "FOREIGN")):
                kind = m[2] or m[4]
                cols.append((m[1] or m[3], "long" if NUMBER.match(kind) else "double" if kind.lower() in ("float", "double", "decimal") else "string"))
        out[name] = cols
    return out


def read_dump(spark: SparkSession, path: str, columns: list[tuple[str, str]]) -> DataFrame:
    r"""A tab-separated dump without header, `\N` for null."""
    return spark.read.csv(path, sep="\t", nullValue="\\N", quote="", schema=", ".join(f"`{n}` {t}" for n, t in columns))


def read_dump_with_ddl(spark: SparkSession, path: str, ddl_path: str, table: str) -> DataFrame:
    """A dump whose columns a .sql or .sql.gz file declares."""
    text = "\n".join(r["value"] for r in lines(spark, ddl_path).collect())  # a schema file
    return read_dump(spark, path, ddl_columns(text)[table])


def read_ndjson(spark: SparkSession, path: str, schema: str, nested: str | None = None) -> DataFrame:
    """Line-delimited JSON; with `nested` one row per element of that array, its fields beside the others."""
    rows = spark.read.schema(schema).json(path)
    if nested is None:
        return rows
    return rows.withColumn("_x", F.explode(nested)).select(*[c for c in rows.columns if c != nested], "_x.*")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows."""
    return spark.createDataFrame(rows, schema)


def write(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Files of one kind (parquet, csv, json), written over; arrays become &-joined text in csv."""
    if kind == "csv":
        df = df.select(*[F.array_join(c, "&").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes])
        options = {"header": True} | options
    df.write.mode("overwrite").options(**options).format(kind).save(path)


def save_table(df: DataFrame, name: str) -> DataFrame:
    """A managed table, written over."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def assemble_transcripts(transcript: DataFrame, gene: DataFrame, seq_region: DataFrame, attribs: DataFrame) -> DataFrame:
    """Transcript rows of a relational genome dump: names by surrogate keys, flags and values from an attribute table.

    transcript(transcript_id, gene_id, seq_region_id, start, end_pos, strand, stable_id, biotype), gene(gene_id, stable_id,
    symbol), seq_region(seq_region_id, name, coord_system), attribs(transcript_id, code, value)."""
    per = attribs.groupBy("transcript_id").agg(F.collect_set("code").alias("codes"), F.max(F.when(F.col("code") == "TSL", F.col("value"))).alias("tsl"), F.max(F.when(F.col("code") == "appris", F.col("value"))).alias("appris"))
    has = lambda code, name: F.coalesce(F.array_contains("codes", code), F.lit(False)).alias(name)
    regions = seq_region.where("coord_system = 'chromosome'").select("seq_region_id", F.col("name").alias("chrom"))
    named = gene.select("gene_id", F.col("stable_id").alias("gene"), "symbol")
    joined = transcript.join(regions, "seq_region_id").join(named, "gene_id", "left").join(per, "transcript_id", "left")
    return joined.select(
        F.col("stable_id").alias("transcript_id"), "chrom", "start", "end_pos", "strand", F.col("gene").alias("gene_id"), F.col("symbol").alias("gene_symbol"), "biotype",
        has("is_canonical", "canonical"), has("MANE_Select", "mane_select"), has("cds_start_NF", "cds_start_nf"), has("cds_end_NF", "cds_end_nf"), has("_selenocysteine", "seleno"),
        F.regexp_extract("tsl", r"(\d+)", 1).try_cast("long").alias("tsl"), F.coalesce("appris", F.lit("")).alias("appris"),
    )
