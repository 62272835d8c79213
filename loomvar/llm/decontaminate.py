"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: words in lower case, operators, and as typed placeholders numbers, capitalised
words within a sentence (at its beginning, if another one follows) and units after a number. Windows of WINDOW template tokens with at least LITERALS words or operators
among them are hashed and joined with the windows of the benchmark; a match is a pair (document, item) with an alignment
(document position less item position). Within a pair and alignment the slots must be consistent: one benchmark value stands
for one document value and the other way round. An alignment is refused if more of its windows conflict than fit. A document
is contaminated by an item if the consistent windows cover at least COVER of the item's windows, or RUN windows of it. Items
shorter than a window are one window of their own length.

Every item has a path. Windows with fewer literal tokens match by their values: their key is a hash of template and slot
values, and they count beside the others, towards COVER of all windows or RUN. An item that has only such windows, and
EVIDENCE literal tokens in all, also matches by the hash of its whole template, if its slots are consistent from end to end:
that is how re-parameterised arithmetic is found (with fewer than LITERALS of them it must begin and end with a sentence
or line of the document). An item of fewer than MIN_TOKENS tokens contaminates the documents that
hold it as a whole sentence or line.

Documents are read once, where they lie; only windows whose hash the benchmark has leave the Python stage. That set of
hashes is broadcast if it has at most MAX_HASHES entries; beyond it all windows go into the shuffled join. The benchmark's
rows are broadcast to the matches if they have at most MAX_BYTES of slots, else merged.

Nulls: a null text has no windows; a null item is ignored. Repeated rows are judged each. An empty documents table gives an
empty result; with an empty benchmark nothing is contaminated. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvar.llm.common import sliced, stored, tidy

WINDOW, LITERALS = 8, 5
COVER, RUN = 0.5, 6
EVIDENCE = 3  # literal tokens of an item that may match by its template alone
MIN_TOKENS = 5  # shorter items are no evidence within a longer sentence, only as the whole of one
STRONG, VALUES, WHOLE = range(3)  # what a benchmark row matches by: template, template and values, the item's whole template
WHOLE_TAG = 0x5DEECE66D1CE4E5B
MAX_HASHES, MAX_BYTES = 2_000_000, 32 << 20
#: Numbers, words, ends of sentences and lines, and operators that do not touch a letter.
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:\n]|(?<![^\W\d_])(?<![-+*/=<>^])[-+*/=<>^]++(?![^\W\d_])")
STOPS = frozenset(".!?:\n")
UNITS = frozenset("km m cm mm mi ft kg g mg lb oz t l ml s ms min h hr hours hour minutes seconds days day years year usd eur dollars euros euro cents percent pct kmh mph watts w kw mb gb tb".split())
STOP, NUM, NAME, UNIT, FIRST = 0, 1, 2, 3, 16
UNKNOWN = -1
CAP = 1 << 40
PRIME = np.uint64(0x9E3779B97F4A7C15)
SLOT_TYPES = {NUM: "num", NAME: "name", UNIT: "unit"}


def word_id(word: str) -> int:
    """A 39-bit id of a lower-case word, the same in every process."""
    h = 0xCBF29CE484222325
    for b in word.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return FIRST + (h >> 26)


class Codes(dict):
    """Token to code, kept for repeated tokens; forgotten when it holds a million."""

    def __init__(self, vocabulary: frozenset[int] | None):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        if token in STOPS:
            code = STOP
        elif token[0].isdigit():
            code = NUM
        else:
            code = word_id(token.lower())
            if self.vocabulary is not None and code not in self.vocabulary:
                code = UNKNOWN
            if len(token) > 1 and token[0].isupper() and token[1:].islower():
                code = CAP + (code if code >= 0 else CAP // 2)
        if len(self) > 1_000_000:
            self.clear()
        self[token] = code
        return code


UNIT_IDS = np.array(sorted(word_id(u) for u in UNITS))


def template(text: str, codes: Codes) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(template codes, all tokens, index of each code's token, number of each code's sentence)."""
    tokens = TOKEN.findall(text)
    raw = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
    cap = raw >= CAP
    after_stop = np.ones(len(raw), bool)
    after_stop[1:] = raw[:-1] == STOP
    raw = np.where(cap, np.where(raw - CAP >= CAP // 2, UNKNOWN, raw - CAP), raw)
    paired = np.append(cap[1:] & cap[:-1], False)
    raw[cap & (~after_stop | paired)] = NAME
    if len(raw):
        after_num = np.zeros(len(raw), bool)
        after_num[1:] = raw[:-1] == NUM
        if after_num.any():
            raw[after_num & np.isin(raw, UNIT_IDS)] = UNIT
    kept = np.flatnonzero(raw != STOP)
    return raw[kept], tokens, kept, np.cumsum(raw == STOP)[kept]


def windows(codes: np.ndarray, size: int, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, numbers of literal words) of the windows without unknown words and with `least` literal ones."""
    n = len(codes) - size + 1
    if n <= 0 or size <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    known = np.concatenate(([0], np.cumsum(codes >= 0)))
    words = np.concatenate(([0], np.cumsum(codes >= FIRST)))
    literal = words[size:] - words[:-size]
    at = np.flatnonzero((known[size:] - known[:-size] == size) & (literal >= least))
    h = np.full(len(at), size, np.uint64)
    for k in range(size):
        h = (h ^ codes[at + k].astype(np.uint64)) * PRIME
        h ^= h >> np.uint64(29)
    return at, h.view(np.int64), literal[at]


def sentences(part: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size the positions of the sentences and lines that have it; the whole text counts as one too."""
    n = len(part)
    start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if n else np.empty(0, np.int64)
    length = np.diff(np.append(start, n))
    return {k: np.union1d(start[length == k], [0] if n == k else []).astype(np.int64) for k in sizes}


def slots(codes: np.ndarray, tokens: list[str], kept: np.ndarray, at: int, size: int) -> str:
    """The window's slot values in order, as JSON."""
    return json.dumps([tokens[kept[k]].lower() for k in range(at, at + size) if codes[k] < FIRST])


def values_key(template_hash: int, values: str, alone: bool) -> int:
    """Of a window and its slot values; of a text that is nothing else, if `alone`."""
    return int.from_bytes(hashlib.blake2b(f"{template_hash} {int(alone)} {values}".encode(), digest_size=8).digest(), "big", signed=True)


def among(ordered: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of h the ascending array has."""
    if not len(ordered):
        return np.zeros(len(h), bool)
    return ordered[np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)] == h


def benchmark_windows(bench: DataFrame) -> DataFrame:
    """item_id, n_windows, n_strong, kind, pos, size, template, hash, slots of all items; codes of an item's words in `words`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(None)
        for batch in sliced(batches):
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                c, tokens, kept, _ = template(text.as_py() or "", codes)
                size = min(WINDOW, len(c))
                at, h, literal = windows(c, size)
                strong = (literal >= min(LITERALS, size)) & (size >= MIN_TOKENS)
                words = [int(x) for x in np.unique(c) if x >= FIRST]
                one = {"item_id": item, "n_windows": len(at), "n_strong": int(strong.sum()), "words": []}
                for p, x, st in zip(at.tolist(), h.tolist(), strong.tolist()):
                    values = slots(c, tokens, kept, p, size)
                    out.append(one | {"kind": STRONG if st else VALUES, "item_pos": p, "size": size, "template": x, "hash": x if st else values_key(x, values, size < MIN_TOKENS), "item_slots": values, "words": words if p == 0 else []})
                if len(c) >= MIN_TOKENS and not strong.any() and (c >= FIRST).sum() >= EVIDENCE:
                    x = int(windows(c, len(c))[1][0])
                    out.append(one | {"kind": WHOLE, "item_pos": 0, "size": len(c), "template": x, "hash": x ^ WHOLE_TAG, "item_slots": slots(c, tokens, kept, 0, len(c))})
            schema = pa.schema([("item_id", pa.int64()), ("n_windows", pa.int64()), ("n_strong", pa.int64()), ("kind", pa.int32()), ("item_pos", pa.int64()), ("size", pa.int32()), ("template", pa.int64()), ("hash", pa.int64()), ("item_slots", pa.string()), ("words", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_pylist(out, schema)

    rows = bench.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(tidy(run), "item_id long, n_windows long, n_strong long, kind int, item_pos long, size int, template long, hash long, item_slots string, words array<long>")


def candidates(docs: DataFrame, hashes: np.ndarray | None, templates: list[np.ndarray], vocabulary: frozenset[int] | None, sizes: list[list[int]]) -> DataFrame:
    """row_id, doc_id, text_hash, found: array of (hash, pos, slots); one row per document.

    `templates` and `sizes` are those of each kind; without `hashes` all windows of these sizes are found.
    """
    found_type = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int64()), ("slots", pa.string())]))
    keys = frozenset(hashes.tolist()) if hashes is not None and sizes[VALUES] else frozenset()
    within = [sorted(k for k in sizes[STRONG] if k >= MIN_TOKENS), sorted(k for k in sizes[VALUES] if k >= MIN_TOKENS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(vocabulary)
        short = [k for k in sizes[VALUES] if k < MIN_TOKENS]
        for batch in sliced(batches):
            out = []
            for text in batch.column(2):
                c, tokens, kept, part = template(text.as_py() or "", codes)
                found = []

                def by_values(size: int, at: np.ndarray, h: np.ndarray) -> None:
                    if hashes is not None:
                        some = among(templates[VALUES], h)
                        at, h = at[some], h[some]
                    for p, x in zip(at.tolist(), h.tolist()):
                        said = slots(c, tokens, kept, p, size)  # noqa: B023
                        key = values_key(x, said, size < MIN_TOKENS)
                        if hashes is None or key in keys:
                            found.append({"hash": key, "pos": p, "slots": said})  # noqa: B023

                for size in sorted({*within[STRONG], *within[VALUES]}):
                    least = min(LITERALS, size)
                    at, h, literal = windows(c, size, 0 if size in sizes[VALUES] else least)
                    strong = literal >= least
                    by_values(size, at[~strong], h[~strong])
                    if hashes is not None:
                        strong &= among(templates[STRONG], h)
                    found += [{"hash": x, "pos": p, "slots": slots(c, tokens, kept, p, size)} for p, x in zip(at[strong].tolist(), h[strong].tolist())]
                for size, whole in sentences(part, short).items() if short else ():
                    if len(whole):
                        at, h, _ = windows(c, size)
                        some = np.isin(at, whole)
                        by_values(size, at[some], h[some])
                for size in sizes[WHOLE]:
                    at, h, literal = windows(c, size, EVIDENCE)
                    fits = among(templates[WHOLE], h) if hashes is not None else np.ones(len(h), bool)
                    if fits.any():  # of few literal tokens only whole sentences
                        edge = np.concatenate(([True], part[1:] != part[:-1], [True]))
                        fits &= (literal >= LITERALS) | edge[at] & edge[at + size]
                    found += [{"hash": x ^ WHOLE_TAG, "pos": p, "slots": slots(c, tokens, kept, p, size)} for p, x in zip(at[fits].tolist(), h[fits].tolist())]
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, found_type)], names=["doc_id", "text_hash", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, text_hash long, found array<struct<hash:long,pos:long,slots:string>>").withColumn("row_id", F.monotonically_increasing_id())


def fitting(pairs: Iterator[tuple[str, str]]) -> Iterator[tuple[bool, bool]]:
    """Of each window whether its slots fit one two-way mapping with those before that do, and have equal values."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    for item, doc in pairs:
        if item == doc == "[]":
            yield True, True
            continue
        a, b = json.loads(item), json.loads(doc)
        if len(a) != len(b) or not len(set(zip(a, b))) == len(set(a)) == len(set(b)) or any(there.get(x, y) != y or back.get(y, x) != x for x, y in zip(a, b)):
            yield False, False
            continue
        there.update(zip(a, b))
        back.update(zip(b, a))
        yield True, a == b


def alone_consistent(item: str, doc: str) -> bool:
    """Whether the slots of one window fit a two-way mapping of their own."""
    a, b = json.loads(item), json.loads(doc)
    return len(a) == len(b) and len(set(zip(a, b))) == len(set(a)) == len(set(b))


def consistent(pairs: Iterator[tuple[str, str]]) -> tuple[int, bool]:
    """(windows whose slots fit one two-way mapping, whether all of these have equal values); windows in page order. None
    count if more windows conflict than fit."""
    told = list(fitting(pairs))
    fits = [same for fit, same in told if fit]
    return (0, False) if 2 * len(fits) < len(told) else (len(fits), all(fits))


FIT = "row_id long, item_id long, of long, of_strong long, n long, n_strong long, whole boolean, exact boolean"


def fit_slots(runs: DataFrame) -> DataFrame:
    """FIT rows: of the matches of a document, item and alignment, how many are consistent."""
    schema = pa.schema([("row_id", pa.int64()), ("item_id", pa.int64()), ("of", pa.int64()), ("of_strong", pa.int64()), ("n", pa.int64()), ("n_strong", pa.int64()), ("whole", pa.bool_()), ("exact", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for matches in batch.column(4).to_pylist():
                some = [m for m in matches if m["kind"] != WHOLE]
                told = list(zip(some, fitting((m["item_slots"], m["slots"]) for m in some)))
                fits = [(m["kind"], same) for m, (fit, same) in told if fit]
                if 2 * len(fits) < len(told):
                    fits = []
                whole = [m["item_slots"] == m["slots"] for m in matches if m["kind"] == WHOLE and alone_consistent(m["item_slots"], m["slots"])]
                rows.append((len(fits), sum(kind == STRONG for kind, _ in fits), bool(whole), all(same for _, same in fits) and all(whole)))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *cols], schema=schema)

    return runs.select("row_id", "item_id", "of", "of_strong", "matches").mapInArrow(tidy(run), FIT)


def judge(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """row_id, doc_id, text_hash, contaminated, items (sorted ids), n_windows, exact of every document."""
    bench_rows = stored(benchmark_windows(bench), "benchmark-windows")
    sizes: list[list[int]] = [[], [], []]  # at most WINDOW each, but for whole items one a length
    for r in bench_rows.select("kind", "size").distinct().collect():
        sizes[r["kind"]].append(r["size"])
    n_hashes = bench_rows.select("hash").distinct().count()
    small = n_hashes <= MAX_HASHES
    hashes = vocabulary = None
    templates: list[np.ndarray] = []
    if small:
        told = bench_rows.select("kind", "template", "hash").distinct().collect()
        hashes = np.unique(np.array([r["hash"] for r in told], np.int64))
        templates = [np.unique(np.array([r["template"] for r in told if r["kind"] == k], np.int64)) for k in (STRONG, VALUES, WHOLE)]
        vocabulary = frozenset(r["w"] for r in bench_rows.select(F.explode("words").alias("w")).distinct().collect()) | frozenset(UNIT_IDS.tolist())  # units are placeholders only where they are known
    found = stored(candidates(docs, hashes, templates, vocabulary, sizes), "decontamination")
    right = bench_rows.drop("words", "size", "template")
    light = (bench_rows.agg(F.sum(F.length("item_slots") + 64)).first()[0] or 0) <= MAX_BYTES
    hits = found.where(F.size("found") > 0).select("row_id", F.explode("found").alias("f")).select("row_id", "f.*")
    pairs = hits.join(F.broadcast(right) if light else right, "hash").groupBy("row_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"))
    # at most one match per window of the item: the group is bounded by the item's length
    runs = pairs.agg(F.array_sort(F.collect_list(F.struct("item_pos", "kind", "item_slots", "slots"))).alias("matches"), F.first("n_windows").alias("of"), F.first("n_strong").alias("of_strong"))

    plain = F.forall("matches", lambda m: (m["item_slots"] == "[]") & (m["slots"] == "[]"))
    split = runs.select("row_id", "item_id", "of", "of_strong", "matches", plain.alias("plain"))
    n_strong = F.size(F.filter("matches", lambda m: m["kind"] == STRONG)).cast("long")
    simple = split.where("plain").select("row_id", "item_id", "of", "of_strong", F.size("matches").cast("long").alias("n"), n_strong.alias("n_strong"), F.lit(False).alias("whole"), F.lit(True).alias("exact"))
    slotted = fit_slots(split.where("not plain"))
    leak = F.col("whole") | ((F.col("of_strong") > 0) & (F.col("n_strong") >= COVER * F.col("of_strong"))) | (F.col("n") >= COVER * F.col("of")) | (F.col("n") >= RUN)
    whole = simple.unionByName(slotted).withColumn("leak", leak).groupBy("row_id", "item_id").agg(F.max("n").alias("n"), F.max("leak").alias("leak"), F.max("exact").alias("exact"))
    bad = whole.where("leak").groupBy("row_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.sum("n").alias("n_windows"), F.max("exact").alias("exact"))
    return found.select("row_id", "doc_id", "text_hash").join(bad, "row_id", "left").select("row_id", "doc_id", "text_hash", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), F.coalesce("exact", F.lit(False)).alias("exact"))


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    bad = judge(docs, bench).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"]), "left_anti")
