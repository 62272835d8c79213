"""Exact top-k by inner product over norm-sorted vectors.

Components become integers floor(SCALE * x); scores are integer inner products, so ties are exact. A d x d second-moment
matrix of all vectors (summed on the executors, d is bounded by MAX_DIM) gives the rotation: its eigenvectors are the right
singular vectors of the data, so the first rotated dimensions hold most of every inner product.

Vectors are dealt into blocks of equal length class by descending norm. The block of the longest vectors is searched first
for all queries; its k-th score is each query's bound for all other blocks. There a vector is skipped if
|q| |v| is under the bound (for a block sorted by norm that ends the block), and then, after a partial sum over the leading
rotated dimensions, if partial + |q_rest| |v_rest| is. What is left is scored in integers. Every bound has a slack above the
rounding error, so pruning never loses a result; ties go to the smaller id.

The queries (a stated set) meet all vectors in blocks: QUERY_BLOCK queries with VECTOR_BLOCK vectors in a task.

Nulls: vectors that are null or hold null or non-finite components take no part; a null id takes no part. A vector of fewer
dimensions than another counts as having zeros there, an empty one as zero. Repeated rows are separate candidates; a query that is repeated is answered once. Candidates with the
query's own id are left out. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomvar.llm.common import stored

SCALE, K = 256, 5
MAX_DIM = 4096
QUERY_BLOCK, VECTOR_BLOCK = 2048, 16_384
LEAD = 0.25  # share of the rotated dimensions in the partial sums
STEP = 2048


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of long), norm2 of the vectors that take part."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("norm2", F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c))


def second_moment(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of v v' over all vectors: one d x d matrix from each task, summed."""

    def run(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            x = np.array(b["v"].tolist(), float).reshape(-1, dim)
            total += x.T @ x
        yield pd.DataFrame({"row": range(dim), "m": list(total)})

    sums = vectors.select("v").mapInPandas(run, "row int, m array<double>").select("row", F.posexplode("m").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x"))
    out = np.zeros((dim, dim))
    for r in sums.collect():  # dim x dim rows, dim <= MAX_DIM
        out[r["row"], r["col"]] = r["x"]
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best by (score descending, id)."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search(q_ids, q, bound, v_ids, v, turn, k):
    """Rows (query, vector, score): for each query the k best of a block that reach its bound."""
    order = np.argsort(-(v * v).sum(1), kind="stable")
    v_ids, v = v_ids[order], v[order]
    d = v.shape[1]
    lead = max(1, int(d * LEAD)) if d > 8 else d
    vf, qf = v.astype(float), q.astype(float)
    rv, rq = vf @ turn, qf @ turn
    norm_v, norm_q = np.sqrt((vf * vf).sum(1)), np.sqrt((qf * qf).sum(1))
    rest_v, rest_q = np.sqrt((rv[:, lead:] ** 2).sum(1)), np.sqrt((rq[:, lead:] ** 2).sum(1))
    out = []
    for i in range(len(q_ids)):
        limit = float(bound[i])
        got_ids, got_scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for a in range(0, len(v_ids), STEP):
            slack = 1e-6 * (1 + norm_q[i] * norm_v[a])
            if norm_q[i] * norm_v[a] + slack < limit:
                break
            part = rv[a : a + STEP, :lead] @ rq[i, :lead] + rest_q[i] * rest_v[a : a + STEP]
            near = a + np.flatnonzero((part + slack >= limit) & (v_ids[a : a + STEP] != q_ids[i]))
            if not len(near):
                continue
            score = v[near] @ q[i]
            got_ids, got_scores = np.append(got_ids, v_ids[near]), np.append(got_scores, score)
            top = best(got_ids, got_scores, k)
            got_ids, got_scores = got_ids[top], got_scores[top]
            if len(top) == k:
                limit = max(limit, float(got_scores[-1]))
        ok = got_scores >= bound[i]
        out.append((np.full(int(ok.sum()), q_ids[i]), got_ids[ok], got_scores[ok]))
    return [np.concatenate([o[j] for o in out]) if out else np.empty(0, np.int64) for j in range(3)]


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores over all other vectors."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    all_ = integers(vectors)
    dim = all_.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], schema)
    if dim > MAX_DIM:
        raise ValueError(f"vectors of {dim} dimensions; {MAX_DIM} is the most")
    dim = max(dim, 1)
    zeros = F.array_repeat(F.lit(0).cast("long"), dim - F.size("v"))
    all_ = stored(all_.withColumn("v", F.concat("v", zeros)), "vectors")
    total = all_.count()
    _, turn = np.linalg.eigh(second_moment(all_, dim))
    turn = turn[:, ::-1].copy()

    n_blocks = max(1, math.ceil(total / VECTOR_BLOCK))
    # block borders by norm: quantiles on the executors; equal norms are dealt over their blocks by id hash
    cuts = all_.select(F.col("norm2").cast("double").alias("norm2")).approxQuantile("norm2", [i / n_blocks for i in range(1, n_blocks)], 0.2 / n_blocks) if n_blocks > 1 else []
    borders = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    above = F.size(F.filter(borders, lambda c: c >= F.col("norm2")))
    at_least = F.size(F.filter(borders, lambda c: c > F.col("norm2")))
    block = (at_least + F.pmod(F.xxhash64("vec_id"), above - at_least + 1)).cast("int")
    dealt = all_.withColumn("block", block)

    queries = all_.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    n_query_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    queries = stored(queries.withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(n_query_blocks)).cast("int")), "queries")

    def joined(asked: DataFrame, found: DataFrame, blocks: list[int]) -> DataFrame:
        """Search `found`'s blocks for `asked` (query_id, q, query_block, bound), one task for a pair of blocks."""
        each = asked.withColumn("block", F.explode(F.array(*[F.lit(b) for b in blocks])))
        spread = found.select("block", "vec_id", "v").withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))

        def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(v):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
            a, b, c = search(q["query_id"].to_numpy(), np.array(q["q"].tolist(), np.int64), q["bound"].to_numpy(float), v["vec_id"].to_numpy(), np.array(v["v"].tolist(), np.int64), turn, k)
            return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

        keys = ["block", "query_block"]
        return each.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = stored(joined(queries.withColumn("bound", F.lit(float("-inf"))), dealt.where("block = 0"), [0]), "longest")
    found = first
    if n_blocks > 1:
        kth = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("bound"))
        asked = queries.join(kth, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        found = first.unionByName(joined(asked, dealt.where("block > 0"), list(range(1, n_blocks))))
    return found.withColumn("rank", F.row_number().over(ranked).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}
"""
