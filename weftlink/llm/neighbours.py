"""Approximate nearest neighbours with a permutation index.

Each vector is represented by the order in which it sees a set of pivots.  It
is posted in the inverted files of its nearest pivots; a query opens the files
of its own nearest pivots, ranks what it finds by the footrule distance (the
sum of rank differences) between the pivot orders, and reranks the best by the
exact inner product.

Pivots are a bounded sample; every row is indexed.  Files are cut into pieces
of bounded size, and so are the queries that open them, so no task holds a
whole file.  Of identical vectors only the smallest ids can be among a query's
nearest, ties going to smaller ids; the others are left out before posting by a
window limit that runs before the shuffle.  All limits count ids, not rows:
repeated rows go first, and an id with several vectors takes one place.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from .language import sample

FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def ranks(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each vector the rank of each pivot, nearest first, ties by pivot number."""
    order = np.argsort(-(vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ pivots.T), 1, kind="stable")
    out = np.empty(order.shape, np.int16)
    np.put_along_axis(out, order, np.arange(len(pivots), dtype=np.int16)[None], 1)
    return out


def choose_pivots(vectors: DataFrame, most: int) -> np.ndarray:
    """Up to ``most`` different directions among at most 8 * most sampled rows."""
    rows = sample(vectors, F.col("vec_id"), 8 * most).select("vector").toLocalIterator()
    distinct = list(dict.fromkeys(tuple(r["vector"]) for r in rows))[:most]
    if not distinct:
        return np.zeros((0, 0))
    out = np.array(distinct, float)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def footrule(query: np.ndarray, ranks_t: np.ndarray, depth: int) -> np.ndarray:
    """Distances between a query's order and each column of ranks_t (pivot by vector).

    They are sums of rank differences over the query's ``depth`` nearest
    pivots, whose order says most about what is near it.
    """
    near = np.argsort(query, kind="stable")[:depth]
    gap = ranks_t[near]
    gap -= query[near, None]
    return np.abs(gap, out=gap).sum(0, dtype=np.int32)


def search(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, n_pivots: int = 256, depth: int = 32, post: int = 4, probe: float = 0.25, rerank: float = 0.16, chunk: int = 4096, n_queries: int = 1024) -> DataFrame:
    """The k rows of largest inner product found for each query row.

    depth: how many of its nearest pivots a query's order is compared by;
    post: files that a vector is posted in; probe: share of the files that a
    query opens, 48 at least; rerank: share of the ids of a file's piece that
    are reranked, 128 ids at least.  With up to 48 different vectors everything is opened.

    Returns query_id, rank (from 1), vec_id, score; a query's own row is no
    candidate, ties go to smaller ids.  Rows take no part whose id is null or
    whose vector is null, empty, zero, or holds null or non-finite components.
    A query is compared with the rows of its own length; each length has its own
    pivots and jobs.  Rows that share an id count once in a result, with their
    best score.  Other columns are ignored.
    """
    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = sorted(r[0] for r in vectors.where("asks").select(F.size("vector")).distinct().toLocalIterator())
    if not sizes:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.unionByName, [candidates(vectors.where(F.size("vector") == size), k, n_pivots, depth, post, probe, rerank, chunk, n_queries) for size in sizes])
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def candidates(vectors: DataFrame, k: int, n_pivots: int, depth: int, post: int, probe: float, rerank: float, chunk: int, n_queries: int) -> DataFrame:
    """query_id, vec_id, score of the best k ids in each piece that a query meets; all vectors have one length."""
    pivots = choose_pivots(vectors, n_pivots)
    n = len(pivots)
    post, probe_n = min(post, n), min(n, max(48, math.ceil(probe * n)))
    indexed = vectors.select("vec_id", "vector").distinct().withColumn("__n", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).where(F.col("__n") <= k + 1)
    queries = vectors.where("asks").select("vec_id", "vector").distinct()

    def homes(width: int):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    r = ranks(matrix(b.column("vector")), pivots)
                    row, pivot = np.nonzero(r < width)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([b.column("vec_id").take(take), b.column("vector").take(take), pa.array(pivot.astype(np.int32))], ["id", "vector", "pivot"])

        kind = dict(vectors.dtypes)["vector"]
        return lambda df: df.select("vec_id", "vector").mapInArrow(K.tidied(run), f"id long, vector {kind}, pivot int")

    posted, asked = homes(post)(indexed), homes(probe_n)(queries)
    # sizes of the files and of their audiences: one row for each pivot, whatever the input
    filed = dict.fromkeys(range(n), (1, 1)) | {r["pivot"]: (math.ceil(r["v"] / chunk) or 1, math.ceil(r["q"] / n_queries) or 1) for r in posted.select("pivot", F.lit(1).alias("v"), F.lit(0).alias("q")).unionByName(asked.select("pivot", F.lit(0).alias("v"), F.lit(1).alias("q"))).groupBy("pivot").agg(F.sum("v").alias("v"), F.sum("q").alias("q")).toLocalIterator()}
    cuts = lambda i: F.get(F.array(*(F.lit(filed[p][i]) for p in range(n))), F.col("pivot"))
    cell = lambda own, other, name, rest: (lambda df: df.withColumn(name, F.pmod(F.xxhash64("id"), own).cast("int")).withColumn(rest, F.explode(F.sequence(F.lit(0), other - 1))))
    posted = cell(cuts(0), cuts(1), "part", "ask")(posted)
    asked = cell(cuts(1), cuts(0), "ask", "part")(asked)
    keys = ["pivot", "part", "ask"]

    def meet(files: pa.Table, asks: pa.Table) -> pa.Table:
        out = ([], [], [])
        if files.num_rows and asks.num_rows:
            ids, v = np.asarray(files.column("id").combine_chunks()), matrix(files.column("vector"))
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            n_ids, nth_id = len(starts), np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(ids)]))
            q_ids, q = np.asarray(asks.column("id").combine_chunks()), matrix(asks.column("vector"))
            r_v, r_q = np.ascontiguousarray(ranks(v, pivots).T), ranks(q, pivots)
            few = min(n_ids, max(128, math.ceil(rerank * n_ids)) + 1)
            for i in range(len(q)):
                near = np.arange(len(ids))
                if few < n_ids:
                    distance = np.minimum.reduceat(footrule(r_q[i], r_v, depth), starts)
                    chosen = np.zeros(n_ids, bool)
                    chosen[np.argpartition(distance, few - 1)[:few]] = True
                    near = np.flatnonzero(chosen[nth_id])
                near = near[ids[near] != q_ids[i]]
                score = (v[near] * q[i]).sum(1)
                best = np.lexsort((ids[near], -score))
                best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])][:k]
                out[0].append(np.full(len(best), q_ids[i]))
                out[1].append(ids[near][best])
                out[2].append(score[best])
        joined = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query_id": pa.array(joined[0].astype(np.int64)), "vec_id": pa.array(joined[1].astype(np.int64)), "score": pa.array(joined[2].astype(float))})

    return posted.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, FOUND)
