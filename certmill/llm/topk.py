"""Exact top-k search by inner product over norm-sorted blocks of vectors.

Candidates are range partitioned by descending length and cut into blocks; queries
are cut into blocks too, and a task sees one query block and a few candidate blocks,
longest first. A query stops when its length times that of the block's longest
vector cannot reach its k-th score. Within a block, the product over the first
rotated dimensions plus the product of the residual lengths (Cauchy-Schwarz) bounds
each score; only pairs that can still reach the k-th score get the exact integer
product. The rotation is that of the singular vectors of all candidates, found from
their d x d second moments, which is all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from certmill.session import stored

BLOCK = 2048
BLOCKS_PER_TASK = 8
HEAD_DIMS = 16
EXACT = 2.0**53


@dataclass(frozen=True)
class Shape:
    """Facts of all vectors: number, dimensions, and whether float products of integers are exact."""

    rows: int
    dims: int
    exact: bool


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0) -> DataFrame:
    """One stored row per id: ``vec_id, v`` (integer components), ``norm``.

    Rows without id, and vectors that are null or hold null or non-finite components,
    take no part. Where an id repeats, the smallest of its vectors counts.
    """
    x = F.col(embedding)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(fine & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")
    )
    one = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return stored(one.withColumn("norm", F.sqrt(square)), "vectors")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def _shape(vectors: DataFrame) -> Shape:
    largest = F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))
    r = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.max(largest).alias("m")).first()
    dims = max(r["d"] or 0, 1)
    return Shape(r["n"], dims, dims * (r["m"] or 0.0) ** 2 < EXACT)


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """The right singular vectors of all vectors, largest singular value first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for b in batches:
            m = _matrix(b.column("v"), dims).astype(np.float64)
            total += m.T @ m
        i, j = np.divmod(np.arange(dims * dims, dtype=np.int64), dims)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "s": total.ravel()})

    cells = vectors.select("v").mapInArrow(moments, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    second = np.zeros((dims, dims))
    for r in cells.collect():
        second[r["i"], r["j"]] = r["s"]
    if not np.isfinite(second).all():
        return np.eye(dims)
    return np.linalg.eigh((second + second.T) / 2)[1][:, ::-1].copy()


def _blocks(rows: DataFrame, dims: int, size: int) -> DataFrame:
    """Rows of each partition, in their order, as blocks: ids, components, the longest length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def out(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            norms = np.sqrt((m.astype(np.float64) ** 2).sum(1))
            return pa.RecordBatch.from_pydict(
                {"ids": [ids.tobytes()], "data": [m.tobytes()], "longest": [float(norms.max())]}
            )

        for b in batches:
            held.append((b.column("vec_id").to_numpy(), _matrix(b.column("v"), dims)))
            n += b.num_rows
            if n >= size:
                ids, m = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                full = n // size * size
                for at in range(0, full, size):
                    yield out(ids[at : at + size], m[at : at + size])
                held, n = [(ids[full:], m[full:])], n - full
        if n:
            yield out(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    return rows.select("vec_id", "v").mapInArrow(cut, "ids binary, data binary, longest double")


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best (score, smaller id) of each query."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, np.int64)
    return order[np.arange(len(q)) - start < k]


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Row by row integer products; beyond exact floats by whole numbers, held to the range of long."""
    if exact:
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    wide = (a.astype(object) * b.astype(object)).sum(1)
    return np.array([max(-(2**63) + 1, min(2**63 - 1, int(x))) for x in wide], dtype=np.int64)


def search_block(q_ids: np.ndarray, q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], turn: np.ndarray, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the k best of each query among the blocks, longest block first."""
    head = min(HEAD_DIMS, q.shape[1])
    qf = q.astype(np.float64)
    q_turned = qf @ turn[:, :head]
    q_len = np.sqrt((qf**2).sum(1))
    q_rest = np.sqrt(np.maximum(q_len**2 - (q_turned**2).sum(1), 0))
    best_q, best_i, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kth = np.full(len(q), -np.inf)
    for ids, m in blocks:
        v = m.astype(np.float64)
        v_len = np.sqrt((v**2).sum(1))
        slack = 1e-9 * (q_len * v_len.max() + 1)
        live = np.flatnonzero(q_len * v_len.max() + slack >= kth)
        if not len(live):
            break
        turned = v @ turn[:, :head]
        rest = np.sqrt(np.maximum(v_len**2 - (turned**2).sum(1), 0))
        bound = q_turned[live] @ turned.T
        bound += q_rest[live, None] * rest[None, :] + slack[live, None]
        left = (bound >= kth[live, None]) & (q_ids[live, None] != ids[None, :])
        if exact and left.mean() > 0.05:
            scores = (qf[live] @ v.T).astype(np.int64)
            left &= scores >= kth[live, None]
            rows, cols = np.nonzero(left)
            found = scores[rows, cols]
        else:
            rows, cols = np.nonzero(left)
            found = np.concatenate(
                [np.zeros(0, np.int64)]
                + [_products(q[live[rows[a : a + 65536]]], m[cols[a : a + 65536]], exact) for a in range(0, len(rows), 65536)]
            )
        best_q, best_i, best_s = np.concatenate([best_q, live[rows]]), np.concatenate([best_i, ids[cols]]), np.concatenate([best_s, found])
        kept = _best(best_q, best_i, best_s, k)
        best_q, best_i, best_s = best_q[kept], best_i[kept], best_s[kept]
        full = np.bincount(best_q, minlength=len(q)) >= k
        worst = np.full(len(q), np.inf)
        np.minimum.at(worst, best_q, best_s.astype(np.float64))
        kth = np.where(full, worst, -np.inf)
    return q_ids[best_q], best_i, best_s


def lane_of(block: Column, lanes: int) -> Column:
    """The lane of a block: ids start at partition << 33, so their remainders alone would share few lanes."""
    return F.pmod(F.xxhash64(block), F.lit(lanes).cast("long"))


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """The ``k`` highest inner products of each query: ``query_id, rank, vec_id, score``.

    Both frames are those of :func:`integer_vectors`. A query's own id is no candidate;
    ties go to the smaller id; with fewer candidates than ``k`` all are returned, from an empty table none. Vectors of
    different length are compared as if filled with zeros.
    """
    shape = _shape(vectors)
    turn, dims, exact = rotation(vectors, shape.dims), shape.dims, shape.exact
    asked = queries.count()
    query_blocks, lanes = max(1, -(-asked // block)), max(1, -(-shape.rows // (block * BLOCKS_PER_TASK)))
    sorted_rows = vectors.repartitionByRange(F.col("norm").desc(), F.col("vec_id")).sortWithinPartitions(F.col("norm").desc(), "vec_id")
    candidates = _blocks(sorted_rows, dims, block).select(
        "*", lane_of(F.monotonically_increasing_id(), lanes).alias("lane"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"),
    )
    asked_rows = queries.select(
        "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"),
    )

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        left = left.sort_values("longest", ascending=False)
        parts = [
            (np.frombuffer(i, np.int64), np.frombuffer(d, np.int64).reshape(-1, dims))
            for i, d in zip(left["ids"], left["data"], strict=True)
        ]
        q = np.zeros((len(right), dims), np.int64)
        for row, x in enumerate(right["v"]):
            q[row, : len(x)] = x
        a, b, s = search_block(right["vec_id"].to_numpy(np.int64), q, parts, turn, k, exact)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    found = (
        candidates.groupBy("qb", "lane").cogroup(asked_rows.groupBy("qb", "lane"))
        .applyInPandas(search, "query_id long, vec_id long, score long")
    )
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
