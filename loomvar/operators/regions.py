"""Coarse region classes of (position, transcript) pairs, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bits of a mask.
UP, DOWN, INTRON, NC_EXON, CDS, UTR, SPLICE = 1, 2, 4, 8, 16, 32, 64
NAMES = {UP: "upstream", DOWN: "downstream", INTRON: "intron", NC_EXON: "non_coding_exon", CDS: "cds", UTR: "utr", SPLICE: "splice"}
SPLICE_REACH = 8


def region_mask(pos: Column, start: Column, end: Column, strand: Column, exons: Column, cds_start: Column, cds_end: Column) -> Column:
    """Bits of where pos lies; exons is array<struct<start, end>>, coding bounds are 0 or null if there are none."""
    coding = F.coalesce(cds_start, F.lit(0)) != 0
    forward = strand >= 0
    in_exon = F.exists(exons, lambda x: (pos >= x["start"]) & (pos <= x["end"]))
    at_edge = F.exists(exons, lambda x: (F.abs(pos - x["start"]) <= SPLICE_REACH) | (F.abs(pos - x["end"]) <= SPLICE_REACH))
    exonic = F.when(~coding, NC_EXON).when((pos >= cds_start) & (pos <= cds_end), CDS).otherwise(UTR)
    inside = F.when(in_exon, exonic).otherwise(INTRON) + F.when(at_edge, SPLICE).otherwise(0)
    return F.when(pos < start, F.when(forward, UP).otherwise(DOWN)).when(pos > end, F.when(forward, DOWN).otherwise(UP)).otherwise(inside).cast("int")


def explode_mask(mask: Column) -> Column:
    """One row per bit that is set, as its name."""
    return F.explode(F.filter(F.array(*[F.when(mask.bitwiseAND(F.lit(b)) != 0, F.lit(n)) for b, n in NAMES.items()]), lambda x: x.isNotNull()))
