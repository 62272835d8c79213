"""Best-fit packing of tokenised documents after a dominance reduction.

1. Every document is tokenised where it lies (Arrow batches) and cut into pieces; pieces go to a table in the shared
   folder, so that no text is tokenised twice.
2. The plan works on the histogram of piece lengths, which has at most `capacity` rows whatever the size of the corpus.
   The dominance reduction (Martello and Toth) fixes sets that provably dominate every alternative, and what is left is
   packed best-fit decreasing. Both treat all pieces of a length at once: a plan row says which ranks of a length go to
   which run of sequences.
3. Pieces get their rank within their length from per-salt counts and a running sum, so that a length that holds a third
   of all pieces is still spread over many tasks, and look their place up in the plan.

Nulls: a null text counts as empty (the end token alone). Repeated rows are packed each for itself. A null doc_id is kept.
An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomvar.llm.common import few_rows, sliced, stored, tidy

CAPACITY = 2048
END_ID = 0
#: Rows of a plan that may be broadcast; a larger plan is joined by shuffle.
BROADCAST_PLAN_ROWS = 200_000
#: Texts of these characters alone take the fast encoder; all others go to the reference tokenizer itself.
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_encoders: dict[str, tuple] = {}


def encoder(name: str):
    """A function from texts to id arrays: the ids of the tokenizer file `name`, with no special tokens added.

    The file's byte-level BPE also exists as ranks, whose encoder gives the same ids several times faster for texts
    where both libraries' character classes agree (PLAIN). Other texts, and those that spell a special token, are left
    to the tokenizer file.
    """
    if name not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(public_tokenizers.path(name))
        fast = None
        if name == "byte_bpe_50k.json":
            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _encoders[name] = (tok, fast)
    tok, fast = _encoders[name]

    def encode(text: str) -> np.ndarray:
        if fast is not None and not PLAIN.search(text) and "<|" not in text:
            return np.asarray(fast.encode_ordinary(text), dtype="<u4")
        return np.asarray(tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of full length but the first, which may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: PIECES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in sliced(batches):
            doc, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    doc.append(doc_id), piece.append(k), start.append(s), length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), PIECES)


class Plan:
    """Packs a histogram of lengths. bins: list of (number of equal sequences, [(length, times in each)])."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.bins: list[tuple[int, list[tuple[int, int]]]] = []
        self.reduce()
        self.best_fit()

    def take(self, times: int, items: list[tuple[int, int]]) -> None:
        for n, k in items:
            self.left[n] -= k * times
            if not self.left[n]:
                del self.left[n]
        self.bins.append((times, items))

    def largest(self, room: int, without: int) -> int:
        """The largest length that is left and fits into room, where one piece of length `without` is in use."""
        return max((n for n, c in self.left.items() if n <= room and c - (n == without) > 0), default=0)

    def reduce(self) -> None:
        """Fix {j}, or {j, i}, wherever it dominates every feasible set that holds a piece of length j."""
        for j in sorted(self.left, reverse=True):
            while self.left.get(j, 0) > 0:
                room = self.capacity - j
                i = self.largest(room, j)
                if not i:
                    self.take(self.left[j], [(j, 1)])
                    continue
                small, need = [], 2
                for n in sorted(self.left):
                    got = min(need, self.left[n] - (n == j))
                    small += [n] * max(got, 0)
                    need -= max(got, 0)
                    if not need:
                        break
                # i fills the room exactly, or nothing else goes in with any second piece: {j, i} dominates
                if i != room and len(small) == 2 and sum(small) <= room:
                    break
                if i == j:
                    self.take(max(1, self.left[j] // 2), [(j, 2)])
                else:
                    self.take(min(self.left[j], self.left[i]), [(j, 1), (i, 1)])

    def best_fit(self) -> None:
        open_: dict[int, list[tuple[int, tuple]]] = {}  # free room: [(sequences, items)]
        for n in sorted(self.left, reverse=True):
            c = self.left[n]
            while c:
                room = min((r for r in open_ if r >= n), default=0)
                if room:
                    group = open_[room]
                    times, items = group.pop()
                    if not group:
                        del open_[room]
                else:
                    room, times, items = self.capacity, -1, ()
                each = room // n
                if times < 0:
                    times = -(-c // each)
                full = min(times, c // each)
                if full:
                    self._open(open_, room - each * n, full, (*items, (n, each)))
                    c -= full * each
                rest = times - full
                if rest and c:
                    k = min(c, each)
                    self._open(open_, room - k * n, 1, (*items, (n, k)))
                    c -= k
                    rest -= 1
                if rest:
                    self._open(open_, room, rest, items)
        self.left = {}
        for group in open_.values():
            self.bins += [(times, list(items)) for times, items in group]

    def _open(self, open_: dict, room: int, times: int, items: tuple) -> None:
        if room:
            open_.setdefault(room, []).append((times, items))
        else:
            self.bins.append((times, list(items)))

    def rows(self) -> list[tuple[int, int, int, int, int, int]]:
        """(length, first rank, end rank, first sequence, pieces of the length in each, their first offset)."""
        ranks: dict[int, int] = {}
        out, sequence = [], 0
        for times, items in self.bins:
            offset = 0
            for n, k in items:
                r = ranks.get(n, 0)
                out.append((n, r, r + k * times, sequence, k, offset))
                ranks[n] = r + k * times
                offset += n * k
            sequence += times
        return out


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, rows_per_salt: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cutted = stored(pieces(docs, tokenizer, capacity).withColumn("row_id", F.monotonically_increasing_id()), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cutted.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    salts = max(16, sum(counts.values()) // rows_per_salt)
    plan_rows = Plan(counts, capacity).rows()
    names = ("length", "r0", "r1", "seq0", "k", "off0")
    plan = few_rows(spark, dict(zip(names, map(list, zip(*(plan_rows or [(0, 0, 0, 0, 1, 0)]))))), ", ".join(f"{n} long" for n in names))

    salted = cutted.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("row_id")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    small = len(plan_rows) <= BROADCAST_PLAN_ROWS
    placed = ranked.join(F.broadcast(plan) if small else plan, (ranked["length"] == plan["length"]) & (ranked["rank"] >= plan["r0"]) & (ranked["rank"] < plan["r1"])).drop(plan["length"])
    at = F.col("rank") - F.col("r0")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("seq0") + F.floor(at / F.col("k"))).cast("long").alias("sequence_id"),
        (F.col("off0") + (at % F.col("k")) * F.col("length")).cast("long").alias("offset"),
    )
