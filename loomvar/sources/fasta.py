"""Reference sequence as a table of chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 65_536


def read_fasta(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """(chrom, chunk, bases): bases of positions chunk * size + 1 and on. A task holds one contig at a time."""

    def cut(frames):
        for frame in frames:
            for record in frame["value"]:
                name, _, body = record.partition("\n")
                if not name.strip():
                    continue
                bases = "".join(body.split()).upper()
                n = -(-len(bases) // size)
                yield pd.DataFrame({"chrom": [name.split()[0]] * n, "chunk": range(n), "bases": [bases[k * size : (k + 1) * size] for k in range(n)]})

    return spark.read.option("lineSep", ">").text(path).mapInPandas(cut, "chrom string, chunk long, bases string")


def slices(ranges: DataFrame, chunks: DataFrame, keys: list[str], size: int = CHUNK) -> DataFrame:
    """keys and bases of ranges(keys, chrom, start, end), 1-based and closed; ranges without all of their bases are left out."""
    each = ranges.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("start") - 1) / size), F.floor((F.col("end") - 1) / size))))
    first = F.greatest(F.col("start") - F.col("chunk") * size, F.lit(1))
    last = F.least(F.col("end") - F.col("chunk") * size, F.lit(size))
    parts = each.join(chunks, ["chrom", "chunk"]).select(*keys, "start", "end", "chunk", F.substr("bases", first.cast("int"), (last - first + 1).cast("int")).alias("part"))
    whole = parts.groupBy(*keys, "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"]), "").alias("bases"))
    return whole.where(F.length("bases") == F.col("end") - F.col("start") + 1)
