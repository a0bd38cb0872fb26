"""Exact top-k search by inner product: columnar branch-and-bound.

Vectors lie in vertical layout, a row per dimension. A query's scores over a block of candidates are accumulated
dimension block by dimension block; what the remaining dimensions can add is at most the product of the remaining
norms (Cauchy-Schwarz), so candidates that can't reach the k-th best lower bound are compacted away before the next block.
Query blocks meet candidate blocks as pairs of bounded size; each pair gives its k best, and the best of these are merged.

Defined cases: vectors that are null, or hold a null or a non-finite component, take no part; shorter vectors count as
padded with zeros; ties go to the smaller id; rows with the query's own id are not its candidates; repeated rows are
candidates each; a query id that stands in several rows is one query, with the greatest of their vectors; rows without an id take no
part. Components are integers: where a score could exceed a long, ValueError is raised. An empty table gives an empty result.
Columns besides vec_id and embedding are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DIMS, QUERY_ROWS, CANDIDATE_ROWS = 8, 4096, 1024
_PAIR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component x as double; only vectors that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good).select(F.col("vec_id").cast("long"), v.alias("v"))


def _matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vertical layout: a row per dimension, shorter vectors padded with zeros."""
    lists = lists.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((dims, len(lengths)), np.int64)
    if len(lengths) and (lengths == dims).all():
        out[:] = flat.reshape(len(lengths), dims).T
    else:
        at = 0
        for k, n in enumerate(lengths):
            out[:n, k] = flat[at : at + n]
            at += n
    return out


def _tails(columns: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norm of what remains of each vector from each edge on."""
    squares = columns.astype(np.float64) ** 2
    return np.stack([np.sqrt(squares[e:].sum(axis=0)) for e in edges])


def search_block(query_ids, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int, block: int = BLOCK_DIMS) -> tuple[list, list, list]:
    """The k best of one candidate block for each query: query ids, candidate ids, scores. queries and columns are vertical."""
    dims, n = columns.shape
    norms = [np.sqrt((x.astype(np.float64) ** 2).sum(axis=0)).max(initial=0) for x in (queries, columns)]
    if norms[0] * norms[1] >= 2.0**62:
        raise ValueError("scores may exceed a long")
    if norms[0] * norms[1] < 2.0**52:  # partial sums are exact in doubles, whose products are much faster
        queries, columns = queries.astype(np.float64), columns.astype(np.float64)
    order = np.argsort(-(columns.astype(np.float64) ** 2).sum(axis=1), kind="stable")  # heaviest dimensions first
    columns, queries = np.ascontiguousarray(columns[order]), queries[order]
    edges = list(range(block, dims, block)) + [dims]
    tails, query_tails = _tails(columns, edges), _tails(queries, edges)
    first = queries[: edges[0]].T @ columns[: edges[0]] if dims else np.zeros((len(query_ids), n))
    out: tuple[list, list, list] = ([], [], [])
    for q, query_id in enumerate(query_ids):
        alive = np.flatnonzero(ids != query_id)
        scores = first[q, alive]
        for b, edge in enumerate(edges):
            if b:
                scores = scores + queries[edges[b - 1] : edge, q] @ columns[edges[b - 1] : edge, alive]
            if len(alive) <= k or edge == dims:
                continue
            slack = tails[b, alive] * query_tails[b, q] * (1 + 1e-9) + 1e-6
            low = scores - slack
            least = np.partition(low, len(low) - k)[len(low) - k]
            keep = scores + slack >= least
            if not keep.all():
                alive, scores = alive[keep], scores[keep]
        best = np.lexsort((ids[alive], -scores))[:k]
        out[0].extend([query_id] * len(best))
        out[1].extend(ids[alive[best]].tolist())
        out[2].extend(scores[best].astype(np.int64).tolist())
    return out


def top_k(queries: DataFrame, vectors: DataFrame, k: int, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query (vec_id, v) over vectors (vec_id, v)."""
    queries = queries.groupBy("vec_id").agg(F.max("v").alias("v"))
    blocks = lambda df, rows: max(1, -(-df.count() // rows))
    of_queries, of_vectors = blocks(queries, query_rows), blocks(vectors, candidate_rows)
    block = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(n)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # each vector goes to every query block and each query to every candidate block: whole blocks meet, never rows
    left = queries.select(block(of_queries).alias("qb"), every(of_vectors).alias("cb"), "vec_id", "v")
    right = vectors.select(every(of_queries).alias("qb"), block(of_vectors).alias("cb"), "vec_id", "v")

    def pair(_, q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return _PAIR.empty_table()
        dims = max(int(np.diff(x.column("v").combine_chunks().offsets.to_numpy()).max()) for x in (q, c))
        ids = c.column("vec_id").to_numpy()
        found = search_block(q.column("vec_id").to_pylist(), _matrix(q.column("v"), dims), ids, _matrix(c.column("v"), dims), k)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in found], schema=_PAIR)

    pairs = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(pair, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
