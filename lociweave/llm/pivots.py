"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest pivots in order. Its POSTED nearest ones are the inverted lists that hold it;
its DESCRIBED nearest ones, as bits, give shared-pivot counts. Pivots grow with the square root of the number of vectors,
so lists do too. Where two vectors meet in a list their shared pivots are counted first, and those that share at least
SHARED are verified by their cosine in double precision. Lists are cut into blocks and block meets block in a task of
its own, so a list that holds a third of all vectors spreads over many tasks. Only verified links leave a task, added up:
a count for each vector, and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.operators.components import components
from lociweave.sources.scratch import written

LEAST = 0.9
#: The pivots come from a sample of SAMPLED times as many vectors, those with the smallest id hashes: in that order each
#: whose cosine with all pivots so far is below APART, so that copies do not crowd out other directions.
LEAST_PIVOTS, SAMPLED, APART = 128, 4, 0.8
DESCRIBED, POSTED, SHARED = 16, 8, 3
#: Vectors of a block.
BLOCK = 2048


def _unit(flat: np.ndarray) -> np.ndarray:
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def _posts(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each posted pivot of each vector: id, pivot, nearest pivots as bits, the vector's bytes."""
    words = -(-len(pivots) // 64)
    for batch in batches:
        if not batch.num_rows:
            continue
        given = np.asarray(batch.column("vector").flatten()).reshape(batch.num_rows, -1)
        if given.dtype != np.float32:  # single precision is kept as it is, which halves what is sent
            given = given.astype(float)
        unit = _unit(given.astype(float))
        order = np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :DESCRIBED]
        posted = order[:, :POSTED]
        bits = np.zeros((2, batch.num_rows, words), np.uint64)
        for which, near in enumerate((order, posted)):
            for column in near.T:
                bits[which, np.arange(len(column)), column // 64] |= np.uint64(1) << (column % 64).astype(np.uint64)
        raw = [row.tobytes() for row in given]
        many = posted.shape[1]
        take = pa.array(np.repeat(np.arange(batch.num_rows), many))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id").take(take),
                batch.column("n").take(take),
                pa.array(posted.ravel().astype(np.int32)),
                pa.array([row.tobytes() for row in bits[0]]).take(take),
                pa.array([row.tobytes() for row in bits[1]]).take(take),
                pa.array(raw, pa.binary()).take(take),
                pa.array(np.repeat(given.itemsize == 4, len(take))),
            ],
            names=["id", "n", "pivot", "described", "posted", "raw", "single"],
        )


_POSTS = "id long, n long, pivot int, described binary, posted binary, raw binary, single boolean"


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _meet(rows: pa.Table, shared_least: int) -> pa.Table:
    """Links between two blocks of one list (or inside one): counts by vector and a spanning forest.

    A pair that shares several posted pivots is taken in the list of the smallest one only.
    """
    pivot, i, j = (rows[name][0].as_py() for name in ("pivot", "i", "j"))
    block = rows["block"].to_numpy()
    order = np.argsort(block, kind="stable")
    rows, block = rows.take(pa.array(order)), block[order]
    ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
    unit = _unit(_matrix(rows["raw"], np.float32 if rows["single"][0].as_py() else np.float64).astype(float))
    described, posted = _matrix(rows["described"], np.uint64), _matrix(rows["posted"], np.uint64)
    below = np.zeros(posted.shape[1], np.uint64)
    below[: pivot // 64] = np.uint64(2**64 - 1)
    below[pivot // 64] = (np.uint64(1) << np.uint64(pivot % 64)) - np.uint64(1)
    right = np.flatnonzero(block == j)
    links = np.zeros(len(ids), np.int64)
    label = np.arange(len(ids))
    forest: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    lefts = np.flatnonzero(block == i)
    for start in range(0, len(lefts), 256):
        left = lefts[start : start + 256]
        shared = np.zeros((len(left), len(right)), np.uint8)
        for word in range(described.shape[1]):
            shared += np.bitwise_count(described[left, word][:, None] & described[right, word])
        x, y = np.nonzero(shared >= shared_least)
        if len(x) * 8 > shared.size:  # for so many one product of matrices costs less
            cosine = (unit[left] @ unit[right].T)[x, y]
            x, y = left[x], right[y]
        else:
            x, y = left[x], right[y]
            cosine = np.einsum("ij,ij->i", unit[x], unit[y])
        close = cosine >= LEAST - 1e-6
        if i == j:
            close &= x < y
        x, y = x[close], y[close]
        first = ((posted[x] & posted[y] & below) == 0).all(1)
        x, y = x[first], y[first]
        exact = (unit[x] * unit[y]).sum(1) >= LEAST
        x, y = x[exact], y[exact]
        np.add.at(links, x, n[y])
        np.add.at(links, y, n[x])
        flat = np.array([root(k) for k in range(len(ids))]) if len(x) else label
        apart = flat[x] != flat[y]  # what earlier rows have joined needs no edge
        for a, b in zip(x[apart], y[apart], strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                label[max(ra, rb)] = min(ra, rb)
                forest.append((ids[a], ids[b]))
    hit = np.flatnonzero(links)
    a, b = zip(*forest, strict=True) if forest else ((), ())
    none = [None] * len(forest)
    return pa.table(
        {
            "id": pa.concat_arrays([pa.array(ids[hit], pa.int64()), pa.array(none, pa.int64())]),
            "links": pa.concat_arrays([pa.array(links[hit], pa.int64()), pa.array(none, pa.int64())]),
            "a": pa.concat_arrays([pa.array([None] * len(hit), pa.int64()), pa.array(a, pa.int64())]),
            "b": pa.concat_arrays([pa.array([None] * len(hit), pa.int64()), pa.array(b, pa.int64())]),
        }
    )


def linkable(vector):
    """Whether a vector is not null, has only finite components and is not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (id long, vector array of numbers).

    Linked are vectors with a cosine of LEAST or more in double precision; the index finds nearly all of them (the tests
    measure its recall against brute force) and verifies each. Vectors that are null, zero or hold null or non-finite components link with nothing,
    and only vectors of the most common length are indexed with others of it: every length has an index of its own.
    Equal vectors are one class with a multiplicity, so copies are never compared with each other; rows that repeat an id
    and vector count as one, an id with several vectors as its smallest. A null id is left out of links and keeps itself.
    """
    nameless = vectors.where("id is null")
    named = vectors.where("id is not null").groupBy("id").agg(F.min("vector").alias("vector"))
    good = named.where(linkable(F.col("vector"))).withColumn("dim", F.size("vector"))
    same = written(
        good.groupBy("dim", "vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    )
    classes = same.select(F.col("first").alias("id"), "vector", "n", "dim")
    counts = edges = None
    # lengths are a property of the embedding model: a handful, whatever the number of vectors
    for row in classes.select("dim").distinct().collect():
        found = _linked(classes.where(F.col("dim") == row["dim"]).drop("dim"))
        mine = found.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
        arcs = found.where("a is not null").select("a", "b")
        counts = mine if counts is None else counts.union(mine)
        edges = arcs if edges is None else edges.union(arcs)
    if counts is None:
        out = named.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    else:
        many = same.where("n > 1").select("vector", "first", "n")
        member = good.select("id", "vector").join(many, "vector").select("id", "first", "n")
        member = named.select("id").join(member, "id", "left").select("id", F.coalesce("first", "id").alias("first"), F.coalesce("n", F.lit(1)).alias("n"))
        label = components(edges).withColumnRenamed("node", "first")
        out = (
            member.join(counts.withColumnRenamed("id", "first"), "first", "left")
            .join(label, "first", "left")
            .select(
                F.col("id").alias("vec_id"),
                (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"),
                F.coalesce("component_id", "first").alias("component_id"),
            )
        )
    alone = nameless.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def spread(units: np.ndarray, many: int) -> np.ndarray:
    """Up to `many` of the unit vectors, in their order, without those too close to an earlier one."""
    free, chosen = np.ones(len(units), bool), []
    for i in range(len(units)):
        if free[i] and len(chosen) < many:
            chosen.append(i)
            free &= units @ units[i] < APART
    return units[chosen]


def _linked(classes: DataFrame) -> DataFrame:
    """Link counts (id, links) and forest edges (a, b) of distinct vectors (id, vector, n) of one length."""
    many = max(LEAST_PIVOTS, 1 << int(np.ceil(np.log2(2 * np.sqrt(max(1, classes.count()))))))
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLED * many).select("vector").toArrow()  # of the square root's size
    pivots = spread(_unit(np.array(sample["vector"].to_pylist(), dtype=float)), many)
    least = min(SHARED, len(pivots))  # with fewer vectors than that, all of them share all pivots
    posts = written(classes.mapInArrow(lambda batches: _posts(batches, pivots), _POSTS))
    lists = posts.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    # one row for each pivot: bounded
    dealt = posts.join(F.broadcast(lists), "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with")).drop("with", "blocks")
    return written(dealt.groupBy("pivot", "i", "j").applyInArrow(
        lambda rows: _meet(rows, least), "id long, links long, a long, b long"
    ))
