"""Exact top-k search by columnar branch and bound.

Queries and candidates are dealt in blocks; each task holds one block of each.
Candidates lie in vertical layout (one row of the matrix per dimension).  Inner
products are accumulated dimension block by dimension block; after each, a
candidate stays only if its partial score plus the largest score that the
remaining mass allows (Cauchy-Schwarz) can still reach the query's k-th best
lower bound, and the survivors are compacted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a task's blocks and dimensions of an accumulation step.
CANDIDATES, QUERIES, STEP = 8192, 1024, 16
SCALE = 64


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of integers, zero-padded to ``dims`` columns."""
    arr = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    sizes = np.diff(arr.offsets.to_numpy())
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(arr), dims), np.int64)
    rows = np.repeat(np.arange(len(arr)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _order(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: higher score, then smaller id."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= kth)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """(query row, candidate row, score) of each query's k best in the block."""
    exact = float if max(np.abs(q).max(initial=0), 1) * max(np.abs(c).max(initial=0), 1) * q.shape[1] < 2**52 else np.int64
    vertical = np.ascontiguousarray(c.T).astype(exact)
    q = q.astype(exact)
    cuts = list(range(0, q.shape[1], STEP)) + [q.shape[1]]
    mass = lambda m, axis: np.sqrt((m.astype(float) ** 2).sum(axis)) * (1 + 1e-12)
    left_c = [mass(vertical[e:], 0) for e in cuts[1:]]
    left_q = [mass(q[:, e:], 1) for e in cuts[1:]]
    out = []
    for lo in range(0, len(q), 64):
        part = q[lo : lo + 64]
        first = part[:, : cuts[1]] @ vertical[: cuts[1]]
        for n in range(len(part)):
            i = lo + n
            alive = np.flatnonzero(c_ids != q_ids[i])
            score = first[n][alive]
            for step in range(1, len(cuts)):
                if step > 1:
                    a, b = cuts[step - 1], cuts[step]
                    score = score + part[n, a:b] @ vertical[a:b, alive]
                if step == len(cuts) - 1:
                    break
                reach = left_q[step - 1][i] * left_c[step - 1][alive]
                if len(alive) > k:
                    lower = score - reach
                    kth = np.partition(lower, len(lower) - k)[len(lower) - k]
                    stay = score + reach + 0.5 >= kth  # integer scores: half a unit covers the rounding
                    alive, score = alive[stay], score[stay]
            best = _order(score, c_ids[alive], k)
            out.append((np.full(len(best), i), alive[best], score[best].astype(np.int64)))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def _finder(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        dims = max([1, *(n for t in (left, right) for n in t.column("size").to_pylist())])
        q_ids, c_ids = (np.asarray(t.column("id").to_numpy()) for t in (left, right))
        i, j, score = search_block(q_ids, matrix(left.column("v"), dims), c_ids, matrix(right.column("v"), dims), k)
        return pa.table({"query_id": q_ids[i], "vec_id": c_ids[j], "score": score}, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    return lambda key, left, right: run(key, left, right)


def usable(vec: str = "v") -> str:
    """SQL: the vector is not null and holds only finite components."""
    return f"{vec} IS NOT NULL AND forall({vec}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest inner products.

    Components are floor(64 x), x as double, so scores are integers.  ``is_query``
    is a condition on ``id``.  Candidates are all rows but the query's own; ties
    go to the smaller id; fewer than k candidates are all returned.  Vectors
    null or with null or non-finite components, and rows without id, take no
    part.  Of rows that repeat an id the smallest vector counts.  Vectors of
    different lengths are compared with zeros in the missing places.
    """
    v = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        .where("id IS NOT NULL AND " + usable())
        .groupBy("id")
        .agg(F.min("v").alias("v"))
    )
    v = cut(v.select("id", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("v"), F.size("v").alias("size")))
    n, n_q = v.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, q_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-n_q // QUERIES))
    block = lambda m, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    # every query block meets every candidate block once, as (b, q) tasks
    cand = v.withColumn("b", block(blocks, 1)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    quer = v.where(is_query).withColumn("q", block(q_blocks, 2)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = (
        quer.groupBy("b", "q")
        .cogroup(cand.groupBy("b", "q"))
        .applyInArrow(_finder(k), "query_id long, vec_id long, score long")
    )
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
