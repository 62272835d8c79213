"""The names of the regions over each variant, without an exchange of the hits.

Variants and regions are dealt by bin and stream past each other there: a variant goes to the bin of its position alone, a
region to all bins that it can meet a variant of, and a variant's list is made where both are. Hits, which are many more than
variants and regions, are never shuffled, sorted by the engine or spilled. Equal variants are adjacent and merge; a batch is
held at a time, beside the regions of one bin. Variants of more than counting.SPAN bases take `intervals.annotate_regions`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvar.operators.counting import SPAN, narrow
from loomvar.operators.intervals import BIN, annotate_regions

KEYS = ["chrom", "pos", "end_pos", "ref", "alt"]
HITS = 1_000_000  # made at once, if they are of more than one variant
OUT = pa.schema([("chrom", pa.string()), ("pos", pa.int64()), ("end_pos", pa.int64()), ("ref", pa.string()), ("alt", pa.string()), ("n_regions", pa.int64()), ("names", pa.string())])


class Regions:
    """The regions of a bin, by classes of length: those that may reach a variant are neighbours in a class."""

    def __init__(self, t: pa.Table):
        start, end, name = t.column("a").to_numpy(), t.column("b").to_numpy(), t.column("x").combine_chunks()
        text = pc.binary_join_element_wise(name, pc.cast(t.column("a").combine_chunks(), pa.string()), "@")
        order = pc.sort_indices(text).to_numpy()
        self.text = text.take(pa.array(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        kind = np.frexp((end - start + 1).astype(np.float64))[1]
        self.classes = []
        for k in np.unique(kind).tolist():
            some = np.flatnonzero(kind == k)
            some = some[np.argsort(start[some], kind="stable")]
            self.classes.append((int((end - start)[some].max()), start[some], end[some], rank[some]))

    def ranges(self, pos: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.searchsorted(s, pos - longest), np.searchsorted(s, end, "right")) for longest, s, _, _ in self.classes]

    def names(self, pos: np.ndarray, end: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """How many names each variant has, and these, joined."""
        rows, ranks = [], []
        for (lo, hi), (_, _, ends, rank) in zip(self.ranges(pos, end), self.classes):
            n = np.maximum(hi - lo, 0)
            row = np.repeat(np.arange(len(pos)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
            hit = ends[at] >= pos[row]
            rows.append(row[hit])
            ranks.append(rank[at[hit]])
        key = np.concatenate(rows) * len(self.text) + np.concatenate(ranks)
        key.sort()
        row, rank = np.divmod(key, len(self.text))
        if (times > 1).any():
            row, rank = np.repeat(row, times[row]), np.repeat(rank, times[row])
        n = np.bincount(row, minlength=len(pos))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), self.text.take(pa.array(rank)))
        return n, pc.if_else(pa.array(n == 0), pa.scalar(None, pa.string()), pc.binary_join(lists, "&"))


def runs(batch: pa.RecordBatch) -> np.ndarray:
    """Where the runs of equal variants begin."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in ("a", "b", "x", "y"):
        col = batch.column(c)
        v = col.to_numpy() if c in "ab" else col.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def region_names(variants: DataFrame, regions: DataFrame) -> DataFrame:
    """KEYS, n_regions and names (`name@start` of the overlapping regions in ascending order, joined by &; null if there are
    none) per distinct variant. Equal variant rows merge, and their regions add up. Regions without a name do not count."""
    ok = F.col("chrom").isNotNull() & narrow(["end_pos"])
    to_bin = lambda c: F.floor(c / BIN).cast("long")
    rest = annotate_regions(variants.where(~ok), regions)
    names = F.array_join(F.array_sort(F.transform("region_annotations", lambda r: F.concat_ws("@", r["name"], r["start"].cast("string")))), "&")
    rest = rest.select(*KEYS, F.when(F.col("region_annotations").isNull(), 0).otherwise(F.size("region_annotations")).cast("long").alias("n_regions"), names.alias("names"))
    long = lambda c: F.col(c).cast("long")
    named = regions.where("name is not null and chrom is not null and start is not null and end_pos is not null")
    low, high = F.least(long("start"), long("end_pos")), F.greatest(long("start"), long("end_pos"))
    spread = F.explode(F.sequence(to_bin(low - SPAN), to_bin(high)))
    right = named.select("chrom", spread.alias("bin"), F.lit(0).alias("order"), long("start").alias("a"), long("end_pos").alias("b"), F.col("name").alias("x"), F.lit("").alias("y")).where("bin >= 0 and a <= b")
    left = variants.where(ok).select("chrom", to_bin(F.col("pos")).alias("bin"), F.lit(1).alias("order"), long("pos").alias("a"), long("end_pos").alias("b"), F.col("ref").alias("x"), F.col("alt").alias("y"))
    both = right.unionByName(left).repartition("chrom", "bin").sortWithinPartitions("chrom", "bin", "order", "a", "b", "x", "y")

    def made(chrom: str, held: Regions | None, some: pa.RecordBatch, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        def out(a: int, b: int, n: np.ndarray, text: pa.Array) -> pa.RecordBatch:
            cols = [c.slice(a, b - a) for c in (some.column(k) for k in "abxy")]
            return pa.RecordBatch.from_arrays([pa.array([chrom] * (b - a), pa.string()), *cols, pa.array(n, pa.int64()), text], schema=OUT)

        if held is None:
            yield out(0, some.num_rows, np.zeros(some.num_rows, np.int64), pa.nulls(some.num_rows, pa.string()))
            return
        pos, end = some.column("a").to_numpy(), some.column("b").to_numpy()
        most = np.cumsum(sum(np.maximum(hi - lo, 0) for lo, hi in held.ranges(pos, end)) * times)
        a = 0
        while a < len(pos):
            b = max(a + 1, int(np.searchsorted(most, (most[a - 1] if a else 0) + HITS, "right")))
            yield out(a, b, *held.names(pos[a:b], end[a:b], times[a:b]))
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found, held = None, [], None
        last: tuple[pa.RecordBatch, int] | None = None  # the run that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, order = batch.column("bin").to_numpy(), batch.column("order").to_numpy()
            names = batch.column("chrom").dictionary_encode()
            code, chroms = names.indices.to_numpy(), names.dictionary.to_pylist()
            edge = [0, *(np.flatnonzero((bins[1:] != bins[:-1]) | (code[1:] != code[:-1]) | (order[1:] != order[:-1])) + 1).tolist(), len(bins)]
            for a, b in zip(edge, edge[1:]):
                now = (chroms[code[a]], int(bins[a]))
                if key != now:
                    if last:
                        yield from made(key[0], held, last[0], np.array([last[1]]))
                    key, found, held, last = now, [], None, None
                part = batch.slice(a, b - a)
                if not order[a]:
                    found.append(part)
                    continue
                if found:
                    held, found = Regions(pa.Table.from_batches(found)), []
                first = runs(part)
                times = np.diff(np.append(first, part.num_rows))
                some = part.take(pa.array(first))
                if last and all(last[0].column(c)[0] == some.column(c)[0] for c in "abxy"):
                    times[0] += last[1]
                elif last:
                    yield from made(key[0], held, last[0], np.array([last[1]]))
                if some.num_rows > 1:
                    yield from made(key[0], held, some.slice(0, some.num_rows - 1), times[:-1])
                last = (some.slice(some.num_rows - 1), int(times[-1]))
        if last:
            yield from made(key[0], held, last[0], np.array([last[1]]))

    return rest.unionByName(both.mapInArrow(run, "chrom string, pos long, end_pos long, ref string, alt string, n_regions long, names string"))
