"""Exact top-k by inner product: an impact-ordered index processed score at a time, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Component values of one quantisation level.
LEVEL = 16
#: Vectors that share an index, about; fewer, but not below the second number, where else there would be too few tasks.
VECTOR_BLOCK, LEAST_BLOCK = 65_536, 8_192


class ImpactIndex:
    """Posting segments of a block of integer vectors: per dimension and quantised value, the rows that hold it."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        ids, low, high, dim = [], [], [], []
        for d in range(vectors.shape[1]):
            order = np.argsort(vectors[:, d], kind="stable")
            value = vectors[order, d]
            cuts = np.flatnonzero(np.diff(value // LEVEL)) + 1
            for part, v in zip(np.split(order, cuts), np.split(value, cuts)):
                ids.append(part)
                low.append(v[0])
                high.append(v[-1])
                dim.append(d)
        self.ids, self.low, self.high, self.dim = ids, np.array(low, np.int64), np.array(high, np.int64), np.array(dim, np.int64)
        self.sizes = np.array([len(x) for x in ids], np.int64)

    def search(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of everything that can be among the ``k`` best outside ``skip``.

        Segments come by descending impact (largest product they can add). A row's score is at most what
        its seen segments can add plus the next segment's impact for each unseen dimension. Processing
        stops once that proves all but a few rows to lie below ``k`` exactly known scores; the
        rows left are scored exactly.
        """
        v, n, dims = self.vectors, len(self.vectors), self.vectors.shape[1]
        q = query[self.dim]
        top = np.maximum(q * self.low, q * self.high)
        order = np.argsort(-top, kind="stable")
        bound, unseen = np.zeros(n, np.int64), np.full(n, dims, np.int64)
        sizes = self.sizes[order]
        done, few, members = 0, max(4 * k, n // 100), np.arange(n)
        ends = np.searchsorted(np.cumsum(sizes), sizes.sum() * np.array([0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) + 1
        for end in [*np.minimum(ends, len(order)).tolist(), len(order)]:
            if end > done:  # the next segments, all at once
                rows = np.concatenate([self.ids[s] for s in order[done:end]])
                np.add.at(bound, rows, np.repeat(top[order[done:end]], sizes[done:end]))
                unseen -= np.bincount(rows, minlength=n)
                done = end
            most = bound + unseen * (top[order[done]] if done < len(order) else 0)
            most[skip] = np.iinfo(np.int64).min
            best = np.argpartition(-most, min(few, n) - 1)[:few]
            known = np.sort((v[best] @ query)[most[best] > np.iinfo(np.int64).min])[::-1]
            if len(known) < k:
                continue
            members = np.flatnonzero(most >= known[k - 1])
            if len(members) <= few:
                break
        members = np.setdiff1d(members, skip)
        return members, v[members] @ query


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Integer vectors as rows, filled up with zeros."""
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False))
    out = np.zeros((len(vectors), dims), np.int64)
    for i, x in enumerate(np.split(flat, ends[:-1])):
        out[i, : len(x)] = x
    return out


def _search_blocks(batches: Iterator[pa.RecordBatch], k: int, dims: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of each block for each query. Rows come by block, its vectors before its queries; queries stream past the block's index."""
    block, held, ids, index = None, [], None, None
    for batch in batches:
        at = batch.column(0).to_numpy()
        for lo, hi in _runs(at, batch.column(1).to_numpy(zero_copy_only=False)):
            part = batch.slice(lo, hi - lo)
            if at[lo] != block:
                block, held, index = at[lo], [], None
            if not part.column(1)[0].as_py():
                held.append((part.column(2).to_numpy(), _matrix(part.column(3), dims)))
                continue
            if index is None:
                ids = np.concatenate([x for x, _ in held]) if held else np.zeros(0, np.int64)
                index = ImpactIndex(np.concatenate([v for _, v in held]) if held else np.zeros((0, dims), np.int64))
            found = {"query_id": [], "vec_id": [], "score": []}
            for own, q in zip(part.column(2).to_numpy(), _matrix(part.column(3), dims)) if len(ids) else ():
                rows, score = index.search(q, k, np.flatnonzero(ids == own))
                first = np.lexsort((ids[rows], -score))[:k]
                found["query_id"].append(np.full(len(first), own))
                found["vec_id"].append(ids[rows][first])
                found["score"].append(score[first])
            if found["score"]:
                yield pa.RecordBatch.from_pydict({n: np.concatenate(x) for n, x in found.items()})


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that agree in all columns with the row before."""
    n = len(columns[0])
    new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in columns])) + 1 if n else []
    edges = [0, *new, n]
    yield from ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


def top_k(
    vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block: int = VECTOR_BLOCK
) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: for each query the ``k`` highest integer inner products.

    Components become ``floor(scale * x)``. Queries are the rows whose id is divisible by ``every``, candidates
    all rows with another id. Ties go to the smaller id. Vectors fall into blocks by a hash; each block is
    shuffled once and indexed once, and all queries stream past it, which is the only thing that is copied (to every
    block). Every block returns at most ``k`` rows a query. Work grows with queries times vectors, as all of these can matter.

    Rows with a null id, a null vector, or a null or non-finite component take no part. Vectors of
    unequal length are filled up with zeros. With fewer candidates all are returned. Repeated rows count
    as often as they occur, as candidates; a repeated query is asked once for each different vector.
    Empty tables give empty results; other columns are not read. Components so large that a score might not fit
    64 bits are an error.
    """
    x = F.col(vector_col)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
    most = F.max(F.greatest(F.array_max("v"), -(F.array_min("v") + 1)))
    n, dims, top = rows.agg(F.count("*"), F.max(F.size("v")), most).first()
    dims, top = dims or 1, (top or 0) + 1
    if dims * top * top >= 1 << 63:
        raise ValueError(f"inner products of {dims} components of up to {top} do not fit 64 bits")
    tasks = min(2 * vectors.sparkSession.sparkContext.defaultParallelism, n // LEAST_BLOCK)
    blocks = F.lit(max(1, -(-n // block), tasks)).cast("long")
    right = rows.select(F.pmod(F.xxhash64("vec_id", "v"), blocks).alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    left = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(True).alias("asks"), "vec_id", "v")
    placed = right.unionByName(left).repartition("block").sortWithinPartitions("block", "asks")
    found = placed.mapInArrow(lambda batches: _search_blocks(batches, k, dims), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for op6.
ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
 FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
