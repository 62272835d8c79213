"""Quality classifier by co-training of a text view and a metadata view.

Text view: logistic regression over shape statistics of the whole text and over the words that speak for or against a
document in the labelled sample. Metadata view: logistic regression over language, source and length class. Both are first
fitted on labelled rows (a document is good if its quality is 1 and it is not toxic) and calibrated on labelled rows that are
held out. Then, in ROUNDS - 1 exchanges, each view scores every document outside of the sample, and the QUOTA documents of
either class of which it is most confident go to the other view, which is fitted again: with the teacher's calibrated
probability as their label, and less weight than a real one, so that a view that knows little teaches little. At last both
views are calibrated and combined by a logistic regression with weights of at least 0, and score all documents.

Bounds: MAX_LABELLED labelled rows are used for fitting, those with the smallest hash of their id, chosen before any text is
read; MAX_WORDS words, counted and chosen on the executors; QUOTA documents by view, class and exchange, the best of all
documents (ties by hash). The unlabelled documents have no bound: their features (a few hundred bytes each) are written once
to the shared folder and read for every exchange. Broadcast: the ids of the sample and the model.

Nulls: a null text is empty; a null lang, source or n_chars is a class of its own. Rows of labels with a null id, quality or
toxic are ignored; of several rows of an id the worst counts. Repeated documents are scored each; in the sample one of them
counts. An empty documents table gives an empty result. Without labels of both classes every document is kept with a score
of 0.5. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvar.llm.common import BATCH_ROWS, few_rows, forget, give_back, sliced, stored, tidy

MAX_LABELLED, MAX_WORDS = 6_000, 2_000
ROUNDS, QUOTA, PSEUDO_WEIGHT = 3, 100, 0.3
HOLD = 4  # every fourth labelled row is held out for calibration
MIN_DOCS, MIN_CHI2, STEM = 4, 12.0, 5
#: Of the combined, calibrated probability.
REJECT_BELOW = 0.5
WORD = re.compile(r"[^\W\d_]{2,}")
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGIT = b"0123456789"
SIGNS = "|!*%&$#?=<>{}@\"'():;-_/"
SCHEMA = "doc_id long, text_hash long, p_text double, p_meta double, score double, keep boolean"


def shape(text: str) -> list[float]:
    """Statistics of the whole text."""
    raw = text.encode()
    words = text.split()
    n, w = max(len(raw), 1), max(len(words), 1)
    lines = text.split("\n")
    return [
        np.log1p(len(words)),
        len(raw) / w,
        (n - len(raw.translate(None, UPPER))) / n,
        (n - len(raw.translate(None, DIGIT))) / n,
        len(set(words)) / w,
        sum(map(eq, words, words[1:])) / w,
        len(set(lines)) / max(len(lines), 1),
        *(min(text.count(c) / w, 2.0) for c in SIGNS),
    ]


def words_of(text: str) -> set[str]:
    """Words in lower case, and the stems of longer ones: their first STEM letters and a star."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


def meta(lang: str | None, source: str | None, n_chars: int | None) -> list[str]:
    size = "none" if n_chars is None else str(int(np.log2(max(n_chars, 0) + 1)))
    return [f"lang={lang}", f"source={source}", f"size={size}"]


def fit_logistic(x, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, decay: float = 1e-4, rounds: int = 600, least: np.ndarray | None = None) -> np.ndarray:
    """Weights of the columns of x, whose last is 1; full-batch Adam. Rows of no weight do not count; no weight goes under `least`."""
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    m, v = np.zeros(len(w)), np.zeros(len(w))
    total = weight.sum()
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype), -30, 30)))
        g = x.T @ (weight * (p - y)).astype(x.dtype) / total + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if least is not None:
            w = np.maximum(w, least)
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Features:
    """What a document is to the two views: shape statistics, ids of words, ids of metadata values; all as bytes."""

    def __init__(self, words: list[str], metas: list[str]):
        self.words, self.metas = {w: k for k, w in enumerate(words)}, {m: k for k, m in enumerate(metas)}

    def of(self, text: str, lang: str | None, source: str | None, n_chars: int | None) -> tuple[bytes, bytes, bytes]:
        ids = [self.words[w] for w in self.words.keys() & words_of(text)]
        side = [self.metas[m] for m in meta(lang, source, n_chars) if m in self.metas]
        return np.array(shape(text), np.float32).tobytes(), np.array(ids, np.uint16).tobytes(), np.array(side, np.uint16).tobytes()


def summed(blobs: list[bytes], weights: np.ndarray) -> np.ndarray:
    """For each list of ids the sum of their weights."""
    ids = np.frombuffer(b"".join(blobs), np.uint16)
    row = np.repeat(np.arange(len(blobs)), [len(b) // 2 for b in blobs])
    return np.bincount(row, weights[ids], len(blobs))


class Model:
    """Two calibrated views and their combination."""

    def __init__(self, features: Features, rows: list[tuple], y: np.ndarray, hold: np.ndarray):
        """rows: (shape, word ids, metadata ids) of the labelled documents, as bytes."""
        self.features, self.n, self.y = features, len(rows), y
        self.usable = len(set(y.tolist())) == 2
        if not self.usable:
            return
        if len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
            hold = np.zeros(len(y), bool)
        self.hold, self.train = hold if hold.any() else ~hold, ~hold
        shapes = np.array([np.frombuffer(r[0], np.float32) for r in rows])
        self.mean, self.std = shapes.mean(0), shapes.std(0) + 1e-6
        n_told = 2 * QUOTA * (ROUNDS - 1)
        self.views = [np.zeros((self.n + n_told, k), np.float32) for k in (len(self.mean) + len(features.words) + 1, len(features.metas) + 1)]
        for k, r in enumerate(rows):
            for view in (0, 1):
                self.put(view, k, r)
        self.target = [np.concatenate([y, np.zeros(n_told)]) for _ in self.views]
        self.weight = [np.concatenate([self.train.astype(float), np.zeros(n_told)]) for _ in self.views]
        self.told: list[set] = [set(), set()]  # documents that the text view, the metadata view has been told
        self.w: list[np.ndarray | None] = [None, None]
        self.refit()

    def put(self, view: int, at: int, row: tuple) -> None:
        x, first = self.views[view], len(self.mean) if view == 0 else 0
        if view == 0:
            x[at, :first] = np.clip((np.frombuffer(row[0], np.float32) - self.mean) / self.std, -4, 4)
        x[at, first + np.frombuffer(row[1 + view], np.uint16).astype(int)] = 1
        x[at, -1] = 1

    def refit(self) -> None:
        """Fit and calibrate both views."""
        self.scale = []
        for k, x in enumerate(self.views):
            self.w[k] = fit_logistic(x, self.target[k], self.weight[k], self.w[k], rounds=600 if self.w[k] is None else 200)
            z = x[: self.n][self.hold] @ self.w[k]
            a, b = fit_logistic(np.column_stack([z, np.ones(len(z))]), self.y[self.hold], np.ones(len(z)), decay=1e-3, rounds=200, least=np.array([0, -np.inf]))
            self.scale.append((float(a), float(b)))

    def teach(self, found: list[tuple]) -> None:
        """Rows (teacher, p, key, shape, words, metadata) go to the view that is not the teacher."""
        for teacher, p, key, *row in found:
            view = 1 - teacher
            if key not in self.told[view] and self.n + len(self.told[view]) < len(self.views[view]):
                at = self.n + len(self.told[view])
                self.put(view, at, row)
                self.target[view][at], self.weight[view][at] = p, PSEUDO_WEIGHT
                self.told[view].add(key)

    def finish(self) -> None:
        """The combination, and of the rest what scoring needs."""
        z = np.column_stack([*(a * (x[: self.n][self.hold] @ w) + b for x, w, (a, b) in zip(self.views, self.w, self.scale)), np.ones(int(self.hold.sum()))])
        self.w_both = fit_logistic(z, self.y[self.hold], np.ones(len(z)), least=np.array([0, 0, -np.inf]))
        del self.views, self.target, self.weight

    def logits(self, shapes: list[bytes], words: list[bytes], metas: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated, of both views."""
        first = len(self.mean)
        x = np.clip((np.frombuffer(b"".join(shapes), np.float32).reshape(len(shapes), first) - self.mean) / self.std, -4, 4)
        z = x @ self.w[0][:first] + summed(words, self.w[0][first:-1]) + self.w[0][-1]
        s = summed(metas, self.w[1][:-1]) + self.w[1][-1]
        return self.scale[0][0] * z + self.scale[0][1], self.scale[1][0] * s + self.scale[1][1]

    def score(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the text view, the metadata view and both, for rows of features."""
        if not self.usable or not rows:
            return (np.full(len(rows), 0.5),) * 3
        z, s = self.logits(*map(list, zip(*rows)))
        return sigmoid(z), sigmoid(s), sigmoid(self.w_both[0] * z + self.w_both[1] * s + self.w_both[2])


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


FEATURES = "doc_id long, text_hash long, shape binary, words binary, meta binary"
FEATURES_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), *((n, pa.binary()) for n in ("shape", "words", "meta"))])


def featured(docs: DataFrame, features: Features) -> DataFrame:
    """FEATURES of plain documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [features.of(t.as_py() or "", *m) for t, *m in zip(batch.column(2), *(batch.column(k).to_pylist() for k in (3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(3))], schema=FEATURES_SCHEMA)

    return docs.mapInArrow(tidy(run), FEATURES)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[Features, list[tuple], np.ndarray, np.ndarray, list[int]]:
    """(words and metadata values, features, goodness, held out, ids) of the labelled rows."""
    spark = docs.sparkSession
    told = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("chosen_id")).agg(F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("good"))
    ids = [(r["chosen_id"], r["good"]) for r in told.orderBy(F.xxhash64("chosen_id"), "chosen_id").limit(MAX_LABELLED).collect()]
    chosen = few_rows(spark, {"chosen_id": [i for i, _ in ids], "good": [good for _, good in ids], "hold": [k % HOLD == HOLD - 1 for k in range(len(ids))]}, "chosen_id long, good int, hold boolean")  # MAX_LABELLED rows at most
    picked = plain(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"))
    picked = stored(picked.dropDuplicates(["chosen_id"]).select("doc_id", "text_hash", "text", "lang", "source", "n_chars", "good", "hold"), "quality-labelled")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            words = [sorted(words_of(t.as_py() or "")) for t in batch.column(0)]
            metas = [meta(*m) for m in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(metas, pa.list_(pa.string())), batch.column(4)], names=["words", "metas", "good"])

    train = picked.where("not hold")
    sizes = train.agg(F.count("*").alias("n"), F.sum("good").alias("good")).first()
    n, bad = sizes["n"], sizes["n"] - (sizes["good"] or 0)
    each = train.select("text", "lang", "source", "n_chars", "good").mapInArrow(tidy(listed), "words array<string>, metas array<string>, good int")
    k, d = F.col("k"), F.col("b") * float(n) - F.col("k") * float(bad)
    chi2 = d * d * float(n) / (k * (float(n) - k) * float(max(bad * (n - bad), 1)))
    counted = each.select(F.explode("words").alias("word"), "good").groupBy("word").agg(F.count("*").cast("double").alias("k"), F.sum(1 - F.col("good")).cast("double").alias("b"))
    # words whose presence and the label depend on each other
    words = [r["word"] for r in counted.where((k >= MIN_DOCS) & (k < n)).withColumn("chi2", chi2).where(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "word").limit(MAX_WORDS).collect()]
    metas = sorted(r["m"] for r in each.select(F.explode("metas").alias("m")).distinct().collect())  # 3 a labelled row at most
    features = Features(words, metas)
    rows = featured(picked.select("doc_id", "text_hash", "text", "lang", "source", "n_chars"), features).collect()  # MAX_LABELLED rows of bounded size
    forget(picked)
    by_id = {r["doc_id"]: (bytes(r["shape"]), bytes(r["words"]), bytes(r["meta"])) for r in rows}
    at = [j for j, (i, _) in enumerate(ids) if i in by_id]
    return features, [by_id[ids[j][0]] for j in at], np.array([ids[j][1] for j in at], float), np.array([j % HOLD == HOLD - 1 for j in at], bool), [ids[j][0] for j in at]


CONFIDENT = "teacher int, side int, p double, tie long, doc_id long, text_hash long, shape binary, words binary, meta binary"
CONFIDENT_SCHEMA = pa.schema([("teacher", pa.int32()), ("side", pa.int32()), ("p", pa.float64()), ("tie", pa.int64()), *FEATURES_SCHEMA])


def most_confident(table: DataFrame, model: Model, sample: frozenset[int]) -> list[tuple]:
    """Of all documents outside of the sample, the QUOTA with the highest and the lowest p of each view, for `teach`."""
    told = [frozenset(t) for t in model.told]

    def best(rows: list[tuple]) -> list[tuple]:
        # what a view thinks most of as good (side 1) and as bad (side 0); the key breaks ties alike in every split
        return heapq.nsmallest(QUOTA, rows, key=lambda r: (-r[2] if r[1] else r[2], r[3], r[4], r[5]))

    def reduced(held: dict) -> pa.RecordBatch:
        rows = [r for k in held for r in best(held[k])]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(CONFIDENT_SCHEMA)], schema=CONFIDENT_SCHEMA)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a view without any slope on the held-out rows knows nothing to teach
        held: dict[tuple[int, int], list[tuple]] = {(t, side): [] for t in (0, 1) if model.scale[t][0] > 1e-6 for side in (0, 1)}
        for batch in sliced(batches):
            ids, hashes, *blobs = (batch.column(k).to_pylist() for k in range(5))
            fine = [j for j, i in enumerate(ids) if i is not None and i not in sample]
            if not fine:
                continue
            ps = [sigmoid(z) for z in model.logits(*([b[j] for j in fine] for b in blobs))]
            for (t, side), rows in held.items():
                open_ = np.array([j for j, k in enumerate(fine) if (ids[k], hashes[k]) not in told[1 - t]], int)
                p = ps[t][open_]
                edge = np.partition(p, -QUOTA if side else QUOTA - 1)[-QUOTA if side else QUOTA - 1] if len(p) > QUOTA else 0.0 if side else 1.0
                for j in open_[p >= edge if side else p <= edge]:
                    k = fine[j]
                    rows.append((t, side, float(ps[t][j]), hash((ids[k], hashes[k])), ids[k], hashes[k], *(b[k] for b in blobs)))
                held[t, side] = best(rows)
        yield reduced(held)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple]] = {}
        for batch in sliced(batches):
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault((r[0], r[1]), []).append(r)
            held = {k: best(v) for k, v in held.items()}
        yield reduced(held)

    some = table.mapInArrow(tidy(score), CONFIDENT).repartition(8).mapInArrow(tidy(again), CONFIDENT).collect()  # 8 * 4 * QUOTA rows at most
    held: dict[tuple[int, int], list[tuple]] = {}
    for r in some:
        held.setdefault((r["teacher"], r["side"]), []).append(tuple(r))
    return [(t, p, (i, h), bytes(a), bytes(b), bytes(c)) for k in sorted(held) for t, _, p, _, i, h, a, b, c in best(held[k])]


def trained(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model after all exchanges, and the stored FEATURES of all documents."""
    features, rows, y, hold, ids = labelled_sample(docs, labels)
    model = Model(features, rows, y, hold)
    table = stored(featured(plain(docs), features), "quality-features")
    if model.usable:
        for _ in range(ROUNDS - 1):
            model.teach(most_confident(table, Light(model), frozenset(ids)))
            model.refit()
        model.finish()
    return model, table


class Light:
    """Of a model what scoring needs: it travels to the executors, the matrices of the fit do not."""

    logits = Model.logits

    def __init__(self, model: Model):
        self.mean, self.std, self.w, self.scale, self.told = model.mean, model.std, [w.copy() for w in model.w], list(model.scale), model.told


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """SCHEMA: one row per document."""
    model, table = trained(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            p_text, p_meta, both = model.score(list(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p_text), pa.array(p_meta), pa.array(both), pa.array(both >= REJECT_BELOW)], names=["doc_id", "text_hash", "p_text", "p_meta", "score", "keep"])

    return table.mapInArrow(tidy(run), SCHEMA)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all their columns: scored and filtered in one pass, no join."""
    model, table = trained(docs, labels)
    forget(table)

    @F.arrow_udf("boolean")
    def accepts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, *metas in batches:
            keep = []
            for k in range(0, len(text), BATCH_ROWS):
                side = zip(*(m.slice(k, BATCH_ROWS).to_pylist() for m in metas))
                rows = [model.features.of(t.as_py() or "", *m) for t, m in zip(text.slice(k, BATCH_ROWS), side)]
                keep.append(np.asarray(model.score(rows)[2]) >= REJECT_BELOW)
            yield pa.array(np.concatenate(keep) if keep else np.zeros(0, bool))
        give_back()

    return docs.where(accepts(F.col("text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long")))
