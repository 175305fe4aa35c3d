"""Exact top-k inner-product search by Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt into shards of bounded size and queries into blocks; a shard meets a block in one task. There the
rows of each dimension are sorted by value, and each query reads the lists of its non-zero dimensions in step (from the
top where its weight is positive, from the bottom where it is negative), scores every row it meets for the first time,
and stops as soon as the bound on all unmet rows, the sum of weight times the value last read, is below its k-th score.
The first shard is searched before the others: its k-th score is a bound that every other shard starts with. A last
window merges the shards' best rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lociweave.sources.scratch import written

#: Rows of a shard and queries of a block: what one task holds at once.
SHARD_ROWS = 8192
BLOCK_QUERIES = 8192
#: Entries that each list gives in the first round; every further round goes four times as deep.
FIRST_DEPTH = 32


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * component) for each component, or null if the vector or a component is null or not finite."""
    fine = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    return F.when(
        vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    )


def threshold_search(
    matrix: np.ndarray, lists: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, least: float = -np.inf
) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (ids, scores) of one shard for one query, ties to smaller ids, and how many rows were scored.

    matrix: rows by dimension, ids ascending; lists: for each dimension the rows by ascending value. Rows with id `own`
    take no part, and rows below `least`, the k-th score of another shard, need not be found.
    """
    n = len(matrix)
    rising, falling = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    met = np.zeros(n, bool)
    scores = np.zeros(n, matrix.dtype)
    if not query.any():  # every score is 0 and every bound too: no list can stop the search
        met[:] = True
    depth, taken = FIRST_DEPTH, 0
    while taken < n and not met.all():
        upto = min(n, depth)
        fresh = np.zeros(n, bool)
        fresh[lists[:, n - upto : n - taken][rising]] = True
        fresh[lists[:, taken:upto][falling]] = True
        fresh &= ~met
        new = np.flatnonzero(fresh)
        if len(new) > n // 8:  # reading every row in order costs less than fetching so many
            np.copyto(scores, matrix @ query, where=fresh)
        else:
            scores[new] = matrix[new] @ query
        met |= fresh
        taken, depth = upto, depth * 4
        best = scores[met & (ids != own)]
        if len(best) >= k or least > -np.inf:
            kth = max(least, np.partition(best, len(best) - k)[len(best) - k]) if len(best) >= k else least
            bound = (query[rising] * matrix[lists[rising, n - taken], rising]).sum()
            bound += (query[falling] * matrix[lists[falling, taken - 1], falling]).sum()
            if bound < kth:  # at equality an unmet row could still win by its smaller id
                break
    rows = np.flatnonzero(met & (ids != own) & (scores >= least))
    if len(rows) > k:
        kth = np.partition(scores[rows], len(rows) - k)[len(rows) - k]
        rows = rows[scores[rows] >= kth]
    rows = rows[np.lexsort((ids[rows], -scores[rows]))][:k]
    return ids[rows], scores[rows], int(met.sum())


def _exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """A float type in which every inner product is an exact integer, so that BLAS may be used; else 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """(ids ascending, their vectors, the rows in that order)."""
    rows = rows.take(pa.array(np.argsort(rows["id"].to_numpy(), kind="stable")))
    flat = np.asarray(rows["vector"].combine_chunks().flatten(), np.int64)
    return rows["id"].to_numpy(), flat.reshape(len(rows), -1 if len(rows) else 0), rows


def _search(shard: pa.Table, block: pa.Table, k: int) -> pa.Table:
    """What one block of queries finds in one shard, and how many rows each query scored there."""
    ids, matrix, _ = _arrays(shard)
    wanted, queries, asked = _arrays(block)
    found = []
    if len(ids) and len(wanted):
        least = asked["least"].to_numpy(zero_copy_only=False).astype(float)
        kind = _exact_type(matrix, queries)
        matrix, queries = np.ascontiguousarray(matrix.astype(kind)), queries.astype(kind)
        lists = np.ascontiguousarray(np.argsort(matrix, axis=0, kind="stable").T)
        least = np.where(np.isnan(least), -np.inf, least)
        found = [threshold_search(matrix, lists, ids, q, own, k, low) for q, own, low in zip(queries, wanted, least, strict=True)]
    # one more row for each query, without a result: how many of how many rows it scored
    sizes = [len(x[0]) for x in found]
    asked = wanted[: len(found)]
    none = pa.nulls(len(found), pa.int64())
    return pa.table(
        {
            "query_id": pa.array(np.r_[np.repeat(asked, sizes), asked], pa.int64()),
            "vec_id": pa.concat_arrays([pa.array(np.concatenate([x[0] for x in found]) if found else [], pa.int64()), none]),
            "score": pa.concat_arrays([pa.array(np.concatenate([x[1] for x in found]).astype(np.int64) if found else [], pa.int64()), none]),
            "scored": pa.concat_arrays([pa.nulls(sum(sizes), pa.int64()), pa.array([x[2] for x in found], pa.int64())]),
            "of": pa.concat_arrays([pa.nulls(sum(sizes), pa.int64()), pa.array([len(ids)] * len(found), pa.int64())]),
        }
    )


def _clean(rows: DataFrame) -> DataFrame:
    return (
        rows.where("id is not null and vector is not null")
        .groupBy("id")
        .agg(F.min("vector").alias("vector"))
        .withColumn("dim", F.size("vector"))
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k highest inner products of each query with all other vectors.

    vectors and queries: id long, vector array<long>. Rows with a null id or vector take no part; an id that occurs
    again keeps its smallest vector. A query has its own id left out, ties go to the smaller id, and fewer than k
    candidates give them all. Only vectors of one length meet. Empty tables give no rows. Inner products are 64-bit.

    A stated query set against all rows, in blocks: shards times blocks pairs are made, each of bounded size.
    """
    vectors, queries = _clean(vectors), _clean(queries)
    found = written(_found(vectors, queries, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def _found(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of the k best of each shard, so far as they can be among the k best of all.

    A row for each query and shard that met has scored and of instead: the rows scored, of how many.
    """
    vectors, queries = written(vectors), written(queries)  # both are read for each of two searches
    shards = max(1, -(-vectors.count() // (SHARD_ROWS // 2)))
    blocks = max(1, -(-queries.count() // (BLOCK_QUERIES // 2)))
    # half-full parts on average, as a hash deals unevenly; equal keys of both sides meet
    rows = vectors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def search(some: DataFrame, wanted: DataFrame, parts: list[int]) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        left = some.withColumn("block", each).groupBy("dim", "part", "block")
        others = F.explode(F.sequence(F.lit(parts[0]), F.lit(parts[1])))
        right = wanted.withColumn("part", others).groupBy("dim", "part", "block")
        return left.cogroup(right).applyInArrow(
            lambda shard, block: _search(shard, block, k), "query_id long, vec_id long, score long, scored long, of long"
        )

    first = written(search(rows.where("part = 0"), asked.withColumn("least", F.lit(None).cast("long")), [0, 0]))
    if shards == 1:
        return first
    bound = first.where("vec_id is not null").groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    return first.unionByName(search(rows.where("part > 0"), asked.join(bound, "id", "left"), [1, shards - 1]))


def share_scored(vectors: DataFrame, queries: DataFrame, k: int = 20) -> float:
    """The part of all (query, candidate) pairs that the search scores before it stops; takes what `top_k` takes."""
    scored, of = _found(_clean(vectors), _clean(queries), k).agg(F.sum("scored"), F.sum("of")).first()
    return (scored or 0) / max(1, of or 0)
