"""Consequence terms of one changed interval on one transcript without bases, as column expressions.

The same rules as the kernel's, on a transcript without short introns. Splice
terms come from one fold over the introns near the change, as bits; what follows is plain arithmetic over flags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomvar.functions.alleles import let
from loomvar.functions.kernel import SHORT
from loomvar.functions.so_terms import IMPACT, RANK

DONOR, ACCEPTOR, FIFTH, DONOR_REGION, TRACT, INTRON, SPLICE_REGION = (1 << k for k in range(7))
ARRAY = "array<struct<i:long,j:long>>"


def introns(exons: Column) -> Column:
    """array<struct<i, j>> of the gaps between exons in ascending order."""
    ordered = F.array_sort(exons)
    pairs = F.zip_with(F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda a, b: F.struct((a["end"] + 1).alias("i"), (b["start"] - 1).alias("j")))
    return F.filter(pairs, lambda x: x["j"] >= x["i"]).cast(ARRAY)


def has_short(gaps: Column) -> Column:
    return F.exists(gaps, lambda x: x["j"] - x["i"] + 1 <= SHORT)


PARTS = "array<struct<s:long,e:long>>"


def parts(s: Column, e: Column, ref: Column, alt: Column) -> Column:
    """array<struct<s, e>>: the changed stretches of a trimmed change; a substitution of several bases has one for each run of
    bases that differ."""
    n = F.length(ref)
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substr(ref, k, F.lit(1)) != F.substr(alt, k, F.lit(1)))

    def runs(d: Column) -> Column:
        first, last = F.filter(d, lambda k: ~F.array_contains(d, k - 1)), F.filter(d, lambda k: ~F.array_contains(d, k + 1))
        return F.zip_with(first, last, lambda a, b: F.struct((s + a - 1).cast("long").alias("s"), (s + b - 1).cast("long").alias("e")))

    return F.when((n == F.length(alt)) & (n >= 3), let(differ, runs)).otherwise(F.array(F.struct(s.alias("s"), e.alias("e")))).cast(PARTS)


def bit(test: Column, value: int) -> Column:
    return F.when(test, value).otherwise(0)


def splice_bits(s: Column, e: Column, strand: Column, gaps: Column, exonic: Column) -> Column:
    """Bits of the splice and intron terms of the closed interval (s, e); an insertion has e = s - 1."""
    near = F.filter(gaps, lambda x: (F.least(s, e) <= x["j"] + 3) & (F.greatest(s, e) >= x["i"] - 3))
    insertion = s > e
    ov = lambda a, b: (s <= b) & (a <= e)

    def of(x: Column) -> Column:
        i, j = x["i"], x["j"]
        forward = strand > 0
        left, right = ov(i, i + 1), ov(j - 1, j)
        donor, acceptor = F.when(forward, left).otherwise(right), F.when(forward, right).otherwise(left)
        fifth = F.when(forward, ov(i + 4, i + 4)).otherwise(ov(j - 4, j - 4))
        region = F.when(forward, ov(i + 2, i + 5)).otherwise(ov(j - 5, j - 2)) & ~fifth
        a, b = F.when(forward, j - 16).otherwise(i + 2), F.when(forward, j - 2).otherwise(i + 16)
        tract = ~exonic & (F.least(s, e) <= b) & (a <= F.greatest(s, e))
        within = ((s <= j - 2) & (i + 2 <= e)) | (insertion & ((s == i + 2) | (e == j - 2)))
        edge = ov(i - 3, i - 1) | ov(i + 2, i + 7) | ov(j - 7, j - 2) | ov(j + 1, j + 3) | (insertion & (s.isin(i, i + 2) | e.isin(j, j - 2)))
        parts = [bit(donor, DONOR), bit(acceptor, ACCEPTOR), bit(fifth, FIFTH), bit(region, DONOR_REGION), bit(tract, TRACT), bit(within, INTRON), bit(edge & ~(donor | acceptor | region | fifth), SPLICE_REGION)]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return total

    return F.when(F.size(near) > 0, F.aggregate(near, F.lit(0), lambda acc, x: acc.bitwiseOR(of(x)))).otherwise(0)


def all_splice_bits(stretches: Column, strand: Column, gaps: Column, exons: Column) -> Column:
    """The bits of all changed stretches of a variant."""
    each = lambda p: splice_bits(p["s"], p["e"], strand, gaps, F.exists(exons, lambda x: (p["s"] <= x["end"]) & (x["start"] <= p["e"])))
    return F.aggregate(stretches, F.lit(0), lambda acc, p: acc.bitwiseOR(each(p)))


SPLICE = {"splice_donor_variant": DONOR, "splice_acceptor_variant": ACCEPTOR, "splice_donor_5th_base_variant": FIFTH, "splice_donor_region_variant": DONOR_REGION, "splice_polypyrimidine_tract_variant": TRACT, "intron_variant": INTRON, "splice_region_variant": SPLICE_REGION}


def exon_facts(s: Column, e: Column, exons: Column, coding: Column, cds_start: Column, cds_end: Column) -> Column:
    """struct(exonic, low, high, touches, whole): whether the change overlaps an exon, untranslated bases below and above the
    coding ones, coding bases, and whether one coding exon holds it (for an insertion with the bases on both sides)."""
    lo, hi, insertion = F.least(s, e), F.greatest(s, e), s > e
    meets = F.filter(exons, lambda x: (lo <= x["end"]) & (x["start"] <= hi))
    exonic = F.exists(meets, lambda x: (s <= x["end"]) & (x["start"] <= e))
    low = coding & F.exists(meets, lambda x: F.greatest(x["start"], lo) < cds_start)
    high = coding & F.exists(meets, lambda x: F.least(x["end"], hi) > cds_end)
    touches = coding & F.exists(meets, lambda x: (F.greatest(x["start"], cds_start) <= hi) & (lo <= F.least(x["end"], cds_end))) & ~(insertion & ((hi <= cds_start) | (lo >= cds_end)))
    whole = F.exists(meets, lambda x: (x["start"] <= lo) & (hi <= x["end"])) & (cds_start <= lo) & (hi <= cds_end)
    return F.struct(exonic.alias("exonic"), (exonic & low).alias("low"), (exonic & high).alias("high"), (exonic & touches).alias("touches"), whole.alias("whole"))


def flags(ref: Column, alt: Column, strand: Column, x: Column, bits: Column, coding: Column, empty: Column) -> dict[str, Column]:
    """Term to condition, for a change that touches the transcript; the coding ones are those of transcripts without bases."""
    edit, shift = x["touches"] & x["whole"], F.length(alt) - F.length(ref)
    has = lambda b: bits.bitwiseAND(b) != 0
    forward = strand > 0
    return {
        "splice_donor_variant": has(DONOR), "splice_acceptor_variant": has(ACCEPTOR), "splice_donor_5th_base_variant": has(FIFTH), "splice_donor_region_variant": has(DONOR_REGION),
        "splice_polypyrimidine_tract_variant": has(TRACT), "intron_variant": has(INTRON), "splice_region_variant": has(SPLICE_REGION),
        "frameshift_variant": edit & (shift % 3 != 0), "inframe_insertion": edit & (shift > 0) & (shift % 3 == 0), "inframe_deletion": edit & (shift < 0) & (shift % 3 == 0), "missense_variant": edit & (shift == 0),
        "coding_sequence_variant": x["touches"] & ~x["whole"],
        "5_prime_UTR_variant": F.when(forward, x["low"]).otherwise(x["high"]), "3_prime_UTR_variant": F.when(forward, x["high"]).otherwise(x["low"]),
        "non_coding_transcript_exon_variant": ~coding & ~empty & x["exonic"], "non_coding_transcript_variant": empty | (~coding & (has(INTRON) | ~x["exonic"])),
    }


def edit_index(s: Column, e: Column, strand: Column, exons: Column, cds_start: Column, cds_end: Column) -> Column:
    """How many coding bases lie before the change, in the transcript's direction."""
    inside = lambda lo, hi: F.aggregate(exons, F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.least(x["end"], hi) - F.greatest(x["start"], lo) + 1, F.lit(0).cast("long")))
    return F.when(strand > 0, inside(cds_start, F.least(s - 1, cds_end))).otherwise(inside(F.greatest(e + 1, cds_start), cds_end))


def ranked(found: dict[str, Column]) -> tuple[Column, Column]:
    """(terms, most severe first; impact of the first) of conditions."""
    order = sorted(found, key=RANK.get)
    terms = F.filter(F.array(*[F.when(found[t], F.lit(t)) for t in order]), lambda t: t.isNotNull())
    return terms, F.coalesce(*[F.when(found[t], F.lit(IMPACT[t])) for t in order])
