"""Coding effects of single-base substitutions on transcripts with known bases, counted without a row a pair.

Coding bases go to the bins of their transcript as two to a byte; in a bin, the substitutions in each coding exon are a run of
sorted positions, and codons are read, changed and compared in columns. The rules are those of `kernel.coding_effect`; `single`
and `readable` tell which variants and transcripts are meant, all others are for the callers' other ways."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomvar.functions import native
from loomvar.functions.alleles import CODONS
from loomvar.operators import counting
from loomvar.operators.counting import CELLS, whole
from loomvar.operators.termcounts import pieces, ranges

INCOMPLETE = 2 * 64 * 64  # the key of a base behind the last whole codon


def single() -> Column:
    """Whether a prepared variant (VARIANT, kind, _c) replaces one base by another of ACGT."""
    alike = (F.length("_c.ref") == 1) & F.col("_c.alt").isin("A", "C", "G", "T") & (F.col("_c.s") >= 1)
    return F.coalesce(F.col("kind").isNull() & alike, F.lit(False))


def whole_exons() -> Column:
    """Whether a coding transcript's exons lie within it, apart and in no short introns, and both ends of its coding bases in them."""
    ordered = F.array_sort("exons")
    within = lambda c: F.exists("exons", lambda x: (x["start"] <= F.col(c)) & (F.col(c) <= x["end"]))
    close = F.filter(F.zip_with(ordered, F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda a, b: a["end"] + 1 >= b["start"]), lambda x: x)
    placed = (F.col("cds_start") <= F.col("cds_end")) & within("cds_start") & within("cds_end") & (F.col("start") <= F.array_min(F.transform("exons", lambda x: x["start"]))) & (F.col("end_pos") >= F.array_max(F.transform("exons", lambda x: x["end"])))
    return F.coalesce(F.col("coding") & placed & (F.col("strand") != 0) & (F.size(close) == 0) & ~native.has_short(native.introns(F.col("exons"))), F.lit(False))


def readable() -> Column:
    """Whether a coding transcript's bases are known, whole and of ACGT, read in frame by the standard code."""
    bases = F.aggregate("exons", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"] + 1)
    frame = (F.coalesce("cds_phase", F.lit(0)) == 0) & (F.coalesce(F.size("flags"), F.lit(0)) <= 0) & ~F.col("chrom").isin("M", "MT", "chrM", "chrMT")
    return F.coalesce(whole_exons() & frame & (F.length("spliced") == bases) & F.col("spliced").rlike("^[ACGT]*$"), F.lit(False))


@functools.cache
def effects() -> tuple[np.ndarray, list[tuple[str, str]]]:
    """(result of each key, results: term, amino acids); a key is 2 * (64 * old codon + new codon) + whether it is a start codon."""
    results: dict[tuple[str, str], int] = {}
    of = np.empty(INCOMPLETE, np.int64)
    for old, o in enumerate(CODONS):
        for new, n in enumerate(CODONS):
            for start in (0, 1):
                if o == n:
                    term = "stop_retained_variant" if o == "*" else "start_retained_variant" if start else "synonymous_variant"
                else:
                    term = "start_lost" if start else "stop_lost" if o == "*" else "stop_gained" if n == "*" else "missense_variant"
                of[2 * (64 * old + new) + start] = results.setdefault((term, o if o == n else f"{o}/{n}"), len(results))
    return of, list(results)


def segments(t: pa.Table) -> tuple[np.ndarray, ...]:
    """(transcript, first, last, coding bases before) of the coding stretches in ascending order, and each transcript's coding bases."""
    cs, ce = whole(t, "cds_start"), whole(t, "cds_end")
    exons = t.column("exons").combine_chunks()
    of = np.repeat(np.arange(t.num_rows), exons.value_lengths().fill_null(0).to_numpy())
    x, y = (exons.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    x, y = np.maximum(x, cs[of]), np.minimum(y, ce[of])
    some = x <= y
    of, x, y = of[some], x[some], y[some]
    order = np.lexsort((x, of))
    of, x, y = of[order], x[order], y[order]
    done = np.concatenate(([0], np.cumsum(y - x + 1)))
    total = np.bincount(of, y - x + 1, t.num_rows).astype(np.int64)
    first = done[np.searchsorted(of, np.arange(t.num_rows))]  # coding bases of the transcripts before
    return of, x, y, done[:-1] - first[of], total


def effect_counts(variants: DataFrame, transcripts: DataFrame) -> DataFrame:
    """term, amino_acids, n and places (the sum of protein positions) of the substitutions on coding bases."""
    schema = pa.schema([("term", pa.string()), ("amino_acids", pa.string()), ("n", pa.int64()), ("places", pa.int64())])
    ATG = 14  # 16 * A + 4 * T + G

    def count(chrom: str, v: dict[str, np.ndarray], t: pa.Table) -> pa.RecordBatch:
        order = np.argsort(v["pos"], kind="stable")
        pos, alt, times = v["pos"][order], (v["alt"] - v["pos"])[order], v["n"][order]
        forward = whole(t, "strand") > 0
        of, x, y, before, total = segments(t)
        # two bases a byte, each transcript's from a new byte on
        packed = t.column("cds").combine_chunks()
        raw = np.frombuffer(b"".join(packed.to_pylist()), np.uint8)
        bases = np.stack((raw >> 4, raw & 15), 1).ravel().astype(np.int16)
        at0 = np.concatenate(([0], np.cumsum(2 * ((total + 1) // 2))))[:-1]
        code = lambda at: 16 * bases[at] + 4 * bases[at + 1] + bases[at + 2]
        long_ = total >= 3
        starts = np.zeros(t.num_rows, bool)
        starts[long_] = code(at0[long_]) == ATG
        table, results = effects()
        n, places = np.zeros(len(results), np.int64), np.zeros(len(results), np.int64)
        rest = [0, 0]
        a, b = np.searchsorted(pos, x), np.searchsorted(pos, y, "right")
        for part in pieces(b - a, CELLS // 2):
            which, at = ranges(a[part], b[part])
            if not len(at):
                continue
            seg = which + part.start
            tx = of[seg]
            fore = forward[tx]
            idx = np.where(fore, before[seg] + pos[at] - x[seg], total[tx] - 1 - before[seg] - (pos[at] - x[seg]))
            codon, within = idx // 3, idx % 3
            k = times[at]
            cut = 3 * codon + 2 >= total[tx]
            if cut.any():
                rest[0] += int(k[cut].sum())
                rest[1] += int((k * (codon + 1))[cut].sum())
                at, tx, fore, codon, within, k = (c[~cut] for c in (at, tx, fore, codon, within, k))
            place = at0[tx] + 3 * codon
            old = code(place).astype(np.int64)
            new = old + (np.where(fore, alt[at], 3 - alt[at]) - bases[place + within]) * np.array([16, 4, 1])[within]
            result = table[2 * (64 * old + new) + (starts[tx] & (codon == 0))]
            n += np.bincount(result, k, len(results)).astype(np.int64)
            places += np.bincount(result, k * (codon + 1), len(results)).astype(np.int64)
        rows = [(*results[k], int(n[k]), int(places[k])) for k in np.flatnonzero(n).tolist()]
        rows += [(term, "", *rest) for term in ("incomplete_terminal_codon_variant", "coding_sequence_variant") if rest[0]]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    place = F.col("_c.s")
    v = variants.select("chrom", place.alias("pos"), place.alias("end_pos"), (place + F.position("_c.alt", F.lit("ACGT")) - 1).alias("alt"))
    inside = lambda lo, hi: F.aggregate("exons", F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.least(x["end"], hi) - F.greatest(x["start"], lo) + 1, F.lit(0).cast("long")))
    low, high = F.col("cds_start"), F.col("cds_end")
    skipped = F.when(F.col("strand") > 0, inside(F.lit(0), low - 1)).otherwise(inside(high + 1, F.lit(1 << 62)))
    digits = F.translate(F.substr("spliced", (skipped + 1).cast("int"), inside(low, high).cast("int")), "ACGT", "0123")
    tx = transcripts.select(
        "chrom", low.cast("long").alias("start"), high.cast("long").alias("end_pos"), "strand", low.cast("long").alias("cds_start"), high.cast("long").alias("cds_end"),
        F.transform("exons", lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"))).alias("exons"), F.unhex(F.concat(digits, F.when(F.length(digits) % 2 == 1, "0").otherwise(""))).alias("cds"),
    )
    made = counting.per_bin(v, tx, ["alt"], 0, count, "term string, amino_acids string, n long, places long")
    return made.groupBy("term", "amino_acids").agg(F.sum("n").alias("n"), F.sum("places").alias("places"))
