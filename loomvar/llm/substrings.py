"""Substring deduplication over a log-structured fingerprint index.

A window is `width` consecutive words. Each window is filed under its anchor, the ANCHOR-word gram with the least hash in
it, so that equal windows have equal anchors at equal offsets; neighbouring windows mostly share an anchor, and only anchors
are indexed (about one in fourteen words). The windows of one anchor form a block, whose hash stands for all of them.

The log (`FingerprintLog`): every batch of documents leaves one immutable run of its anchors and their blocks, packed and
sorted by anchor within buckets. A new batch's run is merge-joined with the runs of history, bucket by bucket: an anchor that
occurs again, in the batch or in history, reports all its occurrences, so that documents of earlier batches are marked too.
When there are more than FAN_IN runs, the same merge writes them as one (compaction). Of the last batch, if it is known to be
the last, nothing is written but what it finds. If all occurrences of an anchor have one
block hash, all windows of its blocks are repeated. Otherwise they are verified window by window: their hashes (of 64 and of
32 bit) are counted, with partial aggregation, and those that occur twice or more mark their words.

`cut_texts` sends a table through a log in BATCHES batches, by hash, and cuts what the log reports out of the texts. Windows
are judged on the input alone: in how many batches it comes does not matter.

Spread: an anchor with more than HOT occurrences in a piece of a batch is summed up there: only its least and greatest block
travel, and its occurrences ask for the verdict by a join that the adaptive planner can split. So what a bucket gathers of
one anchor is a small share of the pieces, not of the rows. Windows are counted with partial aggregation. A document's
positions are the only other group that is gathered. A bucket is a fixed share of the documents, and buckets are dealt to a
bounded number of tasks, which take one after the other. A text is shuffled once to meet its anchors; only documents with
unverified anchors are shuffled again. Tables of the log go when all that was made of them is stored.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Nulls: a null text has no words. A null doc_id takes part. Repeated rows repeat
all their windows. An empty table gives an empty result. Extra columns are ignored. A text shorter than a window has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvar.llm.common import forget, gathered, partitions, sliced, stored

WIDTH, ANCHOR = 35, 8
POSITION_BITS = 28
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NO_ID = -(1 << 63)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.split() if raw else []  # of bytes: split at \x20 and \x09-\x0D alone


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k modulo 2^64, k < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        m = 1 << max(12, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.ones(m, np.uint64)
            step, k = np.uint64(b), 1
            while k < m:  # doubling: out[k:2k] = out[:k] * b^k
                out[k : 2 * k] = out[:k] * step
                step = np.uint64(int(step) * int(step) & 0xFFFFFFFFFFFFFFFF)
                k *= 2
            both.append(out)
        _powers[base] = have = tuple(both)
    return have


class Rolling:
    """Polynomial hashes of word ranges, modulo 2^64."""

    def __init__(self, h: np.ndarray, base: int):
        up, self.down = powers(base, len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def anchors(h: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """For the words' hashes: position and hash of each anchor, and first and last window of its block and its hash."""
    n = len(h) - width + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 5
    k = min(ANCHOR, width)
    roll = Rolling(h, BASES[0])
    at = np.arange(len(h) - k + 1)
    gram = roll(at, at + k)
    # leftmost least hash of the width - k + 1 grams of a window, by doubling
    low = np.uint64((1 << POSITION_BITS) - 1)
    key = (gram & ~low) | at.astype(np.uint64)
    span, reach = width - k + 1, 1
    while 2 * reach <= span:
        key = np.minimum(key[: len(key) - reach], key[reach:])
        reach *= 2
    least = np.minimum(key[:n], key[span - reach : span - reach + n])
    where = (least & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    last = np.append(first[1:], n) - 1
    pos = where[first]
    return pos, gram[pos].view(np.int64), first, last, roll(first, last + width).view(np.int64)


HOT = 64
BATCHES, FAN_IN = 3, 1
BATCH_WORDS, BATCH_DOCS = 2_000_000, 60_000
NO_OWNER = 0xFFFF
DOCS_PER_BUCKET = 16_000
EXCHANGE = "bucket int, planes binary, block binary, first binary, extent binary, own binary, ids binary, anchor long, k1 long, k2 long, at int, upto int"
EXCHANGE_SCHEMA = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("planes", "block", "first", "extent", "own", "ids")), ("anchor", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int32()), ("upto", pa.int32())])
#: hits: int32 triples (first window, last window, mixed); rows with an anchor: occurrences of hot anchors and their verdicts
FOUND_COLUMNS = ["k1", "k2", "hits", "anchor", "at", "upto", "mixed"]
RUN_COLUMNS = ["bucket", "planes", "block", "first", "extent", "own", "ids"]
FOUND = "k1 long, k2 long, hits binary, anchor long, at int, upto int, mixed boolean, bucket int, planes binary, block binary, first binary, extent binary, own binary, ids binary"
FOUND_SCHEMA = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("hits", pa.binary()), ("anchor", pa.int64()), ("at", pa.int32()), ("upto", pa.int32()), ("mixed", pa.bool_()), ("bucket", pa.int32()), *((n, pa.binary()) for n in RUN_COLUMNS[1:])])


def found_rows(n: int, **columns) -> pa.RecordBatch:
    """n rows of FOUND with these columns, the others null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in FOUND_SCHEMA], schema=FOUND_SCHEMA)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k1 and k2 (a key that is never null), text as bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("k1"), F.xxhash64("text").alias("k2"), F.col("text").cast("binary").alias("text"))


def packed_runs(keys: list[tuple[int, int]], held: list[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of a batch, one for each bucket, and rows of the occurrences of its hot anchors."""
    anchor, first, last, block = (np.concatenate([h[k] for h in held]) for k in range(4))
    own = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
    order = np.lexsort((block, anchor))
    anchor, first, last, block, own = anchor[order], first[order], last[order], block[order], own[order]
    start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.append(start, len(anchor)))
    hot = np.repeat(size > HOT, size)
    ids = np.array(keys, np.int64).reshape(-1, 2)
    if hot.any():
        n = int(hot.sum())
        empty = pa.nulls(n, pa.binary())
        spread = (anchor[hot].astype(np.uint64) + first[hot].astype(np.uint64)) % np.uint64(buckets)
        yield pa.RecordBatch.from_arrays([pa.array(spread.astype(np.int32)), *[empty] * 6, pa.array(anchor[hot]), pa.array(ids[own[hot], 0]), pa.array(ids[own[hot], 1]), pa.array(first[hot].astype(np.int32)), pa.array(last[hot].astype(np.int32))], schema=EXCHANGE_SCHEMA)
        least, most = start[size > HOT], start[size > HOT] + size[size > HOT] - 1
        both = np.concatenate((least, most))
        keep = np.concatenate((np.flatnonzero(~hot), both))
        own = own.copy()
        own[both] = NO_OWNER
        anchor, first, last, block, own = anchor[keep], first[keep], last[keep], block[keep], own[keep]
    key = anchor.astype(np.uint64)
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((key, bucket))
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for k in range(buckets):
        part = order[edges[k] : edges[k + 1]]
        if not len(part):
            continue
        used, local = np.unique(own[part], return_inverse=True)
        none = used == NO_OWNER
        local = np.where(none[local], NO_OWNER, local).astype(np.uint16)
        planes = (key[part] // np.uint64(buckets)).astype(">u8").view(np.uint8).reshape(-1, 8)
        rows.append({"bucket": k, "planes": np.ascontiguousarray(planes.T).tobytes(), "block": block[part].tobytes(), "first": first[part].astype(np.int32).tobytes(), "extent": (last[part] - first[part]).astype(np.uint16).tobytes(), "own": local.tobytes(), "ids": ids[used[~none]].tobytes()})
    yield pa.RecordBatch.from_pylist(rows, EXCHANGE_SCHEMA)


def anchor_runs(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """EXCHANGE rows of keyed documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, words = [], [], 0
        for batch in sliced(batches):
            for k1, k2, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                h = word_hashes(words_of(raw.as_py()))
                _, anchor, first, last, block = anchors(h, width)
                if len(anchor):
                    keys.append((k1, k2))
                    held.append((anchor, first, last, block))
                    words += len(h)
                if words >= BATCH_WORDS or len(held) >= BATCH_DOCS:
                    yield from packed_runs(keys, held, buckets)
                    keys, held, words = [], [], 0
        if held:
            yield from packed_runs(keys, held, buckets)

    return docs.select("k1", "k2", "text").mapInArrow(run, EXCHANGE)


def merge_bucket(bucket: int, parts: list[tuple], buckets: int, compact: bool) -> Iterator[pa.RecordBatch]:
    """FOUND rows of one bucket. parts: (keys, blocks, first windows, extents, owners, ids of owners, whether it is new)."""
    base = np.cumsum([0] + [len(p[5]) for p in parts])
    ids = np.concatenate([p[5] for p in parts])
    key, block, first, extent = (np.concatenate([p[k] for p in parts]) for k in range(4))
    own = np.concatenate([np.where(p[4] == NO_OWNER, -1, p[4].astype(np.int64) + b) for p, b in zip(parts, base)])
    new = np.repeat([p[6] for p in parts], [len(p[0]) for p in parts])
    order = np.lexsort((block, key))
    key, block, first, extent, own, new = key[order], block[order], first[order], extent[order], own[order], new[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    mixed = np.repeat(block[start] != block[start + size - 1], size)
    fresh = np.repeat(np.logical_or.reduceat(new, start), size)
    hot = np.flatnonzero((own < 0) & fresh)
    if len(hot):
        told, at = np.unique(key[hot], return_index=True)
        yield found_rows(len(told), anchor=(told * np.uint64(buckets) + np.uint64(bucket)).view(np.int64), mixed=mixed[hot[at]])
    keep = np.flatnonzero(np.repeat(size > 1, size) & fresh & (own >= 0))
    keep = keep[np.argsort(own[keep], kind="stable")]
    triples = np.column_stack((first[keep], first[keep] + extent[keep], mixed[keep])).astype(np.int32)
    edge = np.flatnonzero(np.concatenate(([True], own[keep][1:] != own[keep][:-1]))) if len(keep) else np.empty(0, np.int64)
    owners = own[keep][edge] if len(keep) else edge
    for lo in range(0, len(edge), 20_000):
        part = range(lo, min(lo + 20_000, len(edge)))
        blobs = [triples[edge[k] : edge[k + 1] if k + 1 < len(edge) else None].tobytes() for k in part]
        who = ids[owners[lo : lo + len(blobs)]]
        yield found_rows(len(blobs), k1=who[:, 0], k2=who[:, 1], hits=blobs)
    if compact:  # the same occurrences as one sorted run; an owner's number has 16 bits, so there may be several pieces
        for lo in range(0, max(len(ids), 1), BATCH_DOCS):
            some = np.flatnonzero((own >= lo) & (own < lo + BATCH_DOCS) | (own < 0) & (lo == 0))
            if len(some):
                local = np.where(own[some] < 0, NO_OWNER, own[some] - lo).astype(np.uint16)
                planes = np.ascontiguousarray(key[some].astype(">u8").view(np.uint8).reshape(-1, 8).T)
                yield found_rows(1, bucket=[bucket], planes=[planes.tobytes()], block=[block[some].tobytes()], first=[first[some].astype(np.int32).tobytes()], extent=[extent[some].astype(np.uint16).tobytes()], own=[local.tobytes()], ids=[ids[lo : lo + BATCH_DOCS].tobytes()])


def unpacked(r: dict) -> tuple:
    n = len(r["own"]) // 2
    key = np.frombuffer(r["planes"], np.uint8).reshape(8, n).T.copy().reshape(-1).view(">u8").astype(np.uint64)
    return key, np.frombuffer(r["block"], np.int64), np.frombuffer(r["first"], np.int32), np.frombuffer(r["extent"], np.uint16), np.frombuffer(r["own"], np.uint16), np.frombuffer(r["ids"], np.int64).reshape(-1, 2), r["new"]


class FingerprintLog:
    """Sorted immutable runs of the anchors of all documents so far, in the shared folder. batches: how many will come, if that
    is known; no run is written of the last."""

    def __init__(self, spark: SparkSession, width: int = WIDTH, buckets: int = 8, fan_in: int = FAN_IN, batches: int | None = None):
        self.spark, self.width, self.buckets, self.fan_in, self.batches = spark, width, buckets, fan_in, batches
        self.runs: list[DataFrame] = []
        self.tables: list[DataFrame] = []
        self.added = self.compactions = 0

    def add(self, docs: DataFrame) -> DataFrame:
        """Append a batch of keyed documents. A stored table of FOUND columns: by document (of the batch or of history) the blocks of anchors that
        the batch has and that occur twice or more, occurrences of hot anchors as they are, and verdicts on hot anchors."""
        self.added += 1
        last = self.added == self.batches
        buckets, compact = self.buckets, len(self.runs) >= self.fan_in and not last
        new = anchor_runs(docs, self.width, buckets)
        if not compact and not last:  # else it is read this once
            new = stored(new, "run")
            self.tables.append(new)
        all_ = new.withColumn("new", F.lit(True))
        for old in self.runs:
            all_ = all_.unionByName(old.where("planes is not null").withColumn("new", F.lit(False)), allowMissingColumns=True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, parts = None, []
            for batch in batches:
                is_run = pa.compute.is_valid(batch.column("planes"))
                loose = batch.filter(pa.compute.invert(is_run))
                if loose.num_rows:
                    yield found_rows(loose.num_rows, **{n: loose.column(n) for n in ("k1", "k2", "anchor", "at", "upto")})
                for r in batch.filter(is_run).select([*RUN_COLUMNS, "new"]).to_pylist():
                    if parts and r["bucket"] != held:
                        yield from merge_bucket(held, parts, buckets, compact)
                        parts = []
                    held = r["bucket"]
                    parts.append(unpacked(r))
            if parts:
                yield from merge_bucket(held, parts, buckets, compact)

        tasks = min(buckets, 4 * max(partitions(self.spark), 8))
        dealt = all_.repartitionById(tasks, F.col("bucket") % tasks)
        merged = (dealt if tasks == buckets else dealt.sortWithinPartitions("bucket")).mapInArrow(run, FOUND)
        if not compact:
            found = stored(merged.select(*FOUND_COLUMNS), "found")
            self.runs += [] if last else [new]
            return found
        merged = stored(merged, "merged")
        found = stored(merged.where("bucket is null").select(*FOUND_COLUMNS), "found")
        forget(*self.tables)
        self.runs, self.tables = [merged.where("bucket is not null").select(*RUN_COLUMNS)], [merged]
        self.compactions += 1
        return found

    def forget(self) -> None:
        """Delete the log's runs."""
        forget(*self.tables)
        self.runs, self.tables = [], []


def covered(n: int, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """Which of n words lie in a window from one of the ranges first..last of window starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(last + width, n), -1)
    return np.cumsum(edge[:n]) > 0


PASS = "doc_id long, k1 long, k2 long, n_words long, n_removed long, kept string, text binary, done_first array<int>, done_last array<int>, at array<int>, h1 array<long>, h2 array<int>"


def cut_texts(docs: DataFrame, width: int = WIDTH, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, k1, k2, n_words, n_removed, kept (the words left, joined by one space) of every document."""
    log = FingerprintLog(docs.sparkSession, width, max(8, docs.count() // DOCS_PER_BUCKET), fan_in, batches)
    tables = [log.add(keyed(docs).where(F.pmod(F.xxhash64("k1", "k2"), F.lit(batches)) == k)) for k in range(batches)]
    log.forget()
    found = tables[0]
    for part in tables[1:]:
        found = found.unionByName(part)
    verdicts = stored(gathered(found.where("anchor is not null and mixed is not null").groupBy("anchor").agg(F.max("mixed").alias("told"))), "verdicts")
    loose = found.where("anchor is not null and mixed is null").select("anchor", "k1", "k2", "at", "upto").join(verdicts, "anchor")
    loose = loose.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "upto", "told")).alias("loose"))
    hits = found.where("hits is not null").groupBy("k1", "k2").agg(F.collect_list("hits").alias("hits")).join(loose, ["k1", "k2"], "full_outer")

    def split_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finish documents without mixed anchors; hash the windows of mixed anchors of the others."""
        schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("text", pa.binary()), ("done_first", pa.list_(pa.int32())), ("done_last", pa.list_(pa.int32())), ("at", pa.list_(pa.int32())), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int32()))])
        for batch in sliced(it):
            out = []
            for doc_id, k1, k2, raw, found, more in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                raw = raw.as_py()
                words = words_of(raw)
                triples = {tuple(t) for x in found or [] for t in np.frombuffer(x, np.int32).reshape(-1, 3).tolist()}
                triples |= {(x["at"], x["upto"], int(x["told"])) for x in more or []}
                done = sorted(t[:2] for t in triples if not t[2])
                mixed = sorted(t[:2] for t in triples if t[2])
                row = {"doc_id": doc_id, "k1": k1, "k2": k2, "n_words": len(words)}
                if mixed:
                    h = word_hashes(words)
                    at = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in mixed]))
                    row |= {"text": raw, "done_first": [a for a, _ in done], "done_last": [b for _, b in done], "at": at.astype(np.int32)}
                    row |= {"h1": Rolling(h, BASES[0])(at, at + width).view(np.int64), "h2": Rolling(h, BASES[1])(at, at + width).astype(np.uint32).view(np.int32)}
                else:
                    kept, gone = leave(words, done, width)
                    row |= {"n_removed": gone, "kept": kept}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)

    both = keyed(docs).join(hits, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "text", "hits", "loose")
    # row: a short name for a document in the exchange of windows, fixed by the table
    passed = stored(both.mapInArrow(split_pass, PASS).withColumn("row", F.monotonically_increasing_id()), "split")
    forget(verdicts, *tables)
    final = ["doc_id", "k1", "k2", "n_words", "n_removed", "kept"]
    ready = passed.where("at is null").select(*final)
    open_ = passed.where("at is not null")
    windows = open_.select("row", F.explode(F.arrays_zip("at", "h1", "h2")).alias("w")).select("row", "w.at", "w.h1", "w.h2")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    twice = stored(twice, "windows")
    marks = windows.join(twice, ["h1", "h2"]).groupBy("row").agg(F.collect_set("at").alias("marks"))

    def last_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        for batch in sliced(it):
            out = []
            for r in batch.to_pylist():
                words = words_of(r["text"])
                kept, gone = leave(words, [*zip(r["done_first"], r["done_last"]), *((a, a) for a in r["marks"] or [])], width)
                out.append({"doc_id": r["doc_id"], "k1": r["k1"], "k2": r["k2"], "n_words": len(words), "n_removed": gone, "kept": kept})
            yield pa.RecordBatch.from_pylist(out, schema)

    rest = open_.select("row", "doc_id", "k1", "k2", "text", "done_first", "done_last").join(marks, "row", "left").drop("row")
    rest = rest.mapInArrow(last_pass, "doc_id long, k1 long, k2 long, n_words long, n_removed long, kept string")
    return ready.unionByName(rest)


def leave(words: list[bytes], ranges: list[tuple[int, int]], width: int) -> tuple[str, int]:
    """(the words outside of all windows that start in the ranges, joined; how many are gone)."""
    if not ranges:
        return b" ".join(words).decode(), 0
    first, last = np.array(ranges, np.int64).T
    gone = covered(len(words), first, last, width)
    return b" ".join([w for w, g in zip(words, gone) if not g]).decode(), int(gone.sum())


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute(texts: list[str | None], width: int = WIDTH) -> list[tuple[int, int, str]]:
    """The definition, for tests: (n_words, n_removed, kept_sha256)."""
    import re
    from collections import Counter

    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in lists for i in range(len(w) - width + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


ORACLE_SQL = rf"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {WIDTH - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM words)
), twice AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS k FROM windows SEMI JOIN twice USING (h)
), each AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""
