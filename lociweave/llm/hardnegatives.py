"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction. Where a block of anchors meets a shard of rows, each cluster sorts the shard once by an
angular upper bound: a row whose angle with the cluster's centre is t scores at most its length times cos(t - w) with any
member of length 1, w being the widest angle of a member. Every member walks that list from the top, scores what it meets,
and ends as soon as the bound of the next row, times its own length, is below all it still looks for: the worst of its
best rows, or the lower end of its score band. Bounds only decide when a walk ends; results are exact integers.

Two searches do the work: the best rows of the same label (positives), and for each positive the best rows of other labels
whose score lies in the band that the positive's score sets (negatives). A search takes shards in rounds, SPREAD times as many
each time, and every round starts from the best that the rounds before have found, so that few rows leave the later ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.llm.topk import _exact_type
from lociweave.sources.scratch import forget, written

POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows of a shard and anchors of a block on average: what one task holds at once.
SHARD_ROWS, BLOCK_ANCHORS = 4096, 4096
#: Anchors of a cluster on average, up to MOST_CLUSTERS; centres are fitted on the SAMPLE anchors with the smallest id hashes.
MEMBERS, MOST_CLUSTERS, SAMPLE, FIT_ROUNDS = 64, 128, 4096, 8
#: Rows of a list that a walk takes first, each further step being twice as long, and shards of a round by those before it.
FIRST_STEP, SPREAD = 128, 16
_NONE = np.iinfo(np.int64).min
#: Added to angles and cosines, so that rounding never makes a bound too small.
_SLACK = 1e-6


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((x * x).sum(1))
    return x / np.where(norms > 0, norms, 1)[:, None], norms


def upper_bounds(rows: np.ndarray, members: np.ndarray) -> np.ndarray:
    """For each row what its score with a vector of length 1 in the direction of any member can be at most."""
    units, norms = _units(members)
    units = units[norms > 0]  # a zero vector scores 0 everywhere, whatever the bound
    directions, lengths = _units(rows)
    centre = units.sum(0)
    size = np.sqrt((centre * centre).sum())
    if not size > 0:
        return lengths
    centre = centre / size
    widest = np.arccos(np.clip(units @ centre, -1, 1)).max()
    angle = np.arccos(np.clip(directions @ centre, -1, 1))
    return lengths * np.minimum(1, np.cos(np.maximum(0, angle - widest - _SLACK)) + _SLACK)


def walk(
    rows: np.ndarray, rank: np.ndarray, bound: np.ndarray, members: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int
) -> tuple[np.ndarray, int]:
    """Keys of the k best rows of every member and target, and how many scores that took.

    rows: the list, as their bounds fall; rank: each row's place by id, in [0, 2^31); own: the rank of the member itself, or -1. low and high
    (members by targets): the band of a target in hundredths of a score; low is inf where nothing is wanted. A key is
    score * 2^31 + (2^31 - 1 - rank), so larger keys come first, with ties to smaller ids; _NONE where there are fewer.
    """
    n, width = len(rows), np.int64(2**31)
    lengths = np.sqrt((members.astype(float) ** 2).sum(1))
    best = np.full((len(members), low.shape[1], k), _NONE)
    alive = np.flatnonzero((low < np.inf).any(1))
    at, step, scored = 0, FIRST_STEP, 0
    while at < n and len(alive):
        upto = min(n, at + step)
        score = (members[alive] @ rows[at:upto].T).astype(np.int64)
        scored += score.size
        key = score * width + (width - 1 - rank[at:upto])
        key[own[alive][:, None] == rank[at:upto]] = _NONE
        score *= 100
        for t in range(low.shape[1]):
            fits = (score >= low[alive, t][:, None]) & (score <= high[alive, t][:, None])
            hit = np.flatnonzero(fits.any(1))
            both = np.concatenate([best[alive[hit], t], np.where(fits[hit], key[hit], _NONE)], 1)
            best[alive[hit], t] = np.partition(both, both.shape[1] - k, 1)[:, -k:]
        at, step = upto, step * 2
        if at < n:
            worst = best[alive].min(2)
            wanted = np.maximum(np.where(worst > _NONE, worst // width, -np.inf), low[alive] / 100)
            # at equality a row further down could still win by its smaller id
            alive = alive[((lengths[alive] * bound[at])[:, None] >= wanted - _SLACK).any(1)]
    return best, scored


def _vectors(rows: pa.Table) -> np.ndarray:
    return np.asarray(rows["vector"].combine_chunks().flatten(), np.int64).reshape(len(rows), -1)


def _search(shard: pa.Table, block: pa.Table, k: int, same: bool) -> pa.Table:
    """What a block of anchors finds in a shard: (anchor, target, id, score), and one row with target -1: scored, of how many."""
    found, scored, of = [], 0, 0
    if len(shard) and len(block):
        shard = shard.take(pa.array(np.argsort(shard["id"].to_numpy(), kind="stable")))
        ids, labels, matrix = shard["id"].to_numpy(), shard["label"].to_numpy(), _vectors(shard)
        anchors, kinds, queries = block["id"].to_numpy(), block["label"].to_numpy(), _vectors(block)
        low = np.asarray(block["low"].combine_chunks().flatten(), float).reshape(len(block), -1)
        high = np.asarray(block["high"].combine_chunks().flatten(), float).reshape(len(block), -1)
        exact = _exact_type(matrix, queries)
        place = np.searchsorted(ids, anchors)
        own = np.where((place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == anchors), place, -1)
        cluster = block["cluster"].to_numpy()
        rank = np.arange(len(ids))
        for c in np.unique(cluster):
            mine = np.flatnonzero(cluster == c)
            bound = upper_bounds(matrix.astype(float), queries[mine].astype(float))
            order = np.argsort(-bound, kind="stable")  # one list for all members of the cluster
            for label in np.unique(kinds[mine]):
                some = mine[kinds[mine] == label]
                wanted = order[(labels[order] == label) == same]  # the list without what the label rules out
                of += len(wanted) * len(some)
                if not len(wanted):
                    continue
                best, n = walk(matrix[wanted].astype(exact), rank[wanted], bound[wanted], queries[some].astype(exact), own[some], low[some], high[some], k)
                scored += n
                a, t, j = np.nonzero(best > _NONE)
                keys = best[a, t, j]
                found.append((anchors[some][a], t, ids[2**31 - 1 - (keys % 2**31)], keys // 2**31))
    columns = [np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(4)]
    columns = [np.append(x, last) for x, last in zip(columns, (-1, -1, of, scored), strict=True)]
    return pa.table({name: pa.array(x.astype(np.int64)) for name, x in zip(("anchor", "target", "id", "score"), columns, strict=True)})


_FOUND = "anchor long, target long, id long, score long"


def _centres(anchors: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(unit centres, their dimension) of spherical k-means over a sample of the anchors of the most common dimension in it."""
    sample = anchors.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sizes = np.array([len(v) for v in sample["vector"]])
    if not len(sizes):
        return np.zeros((0, 0)), 0
    dim = int(np.bincount(sizes).argmax())
    units, norms = _units(np.array([v.as_py() for v, s in zip(sample["vector"], sizes, strict=True) if s == dim], float).reshape(-1, dim))
    units = units[norms > 0]
    clusters = min(MOST_CLUSTERS, max(1, n // MEMBERS), len(units))
    centres = units[:clusters]
    for _ in range(FIT_ROUNDS if len(centres) else 0):
        nearest = (units @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        means, sizes = _units(sums)
        centres = np.where(sizes[:, None] > 0, means, centres)
    return centres, dim


def clustered(anchors: DataFrame) -> DataFrame:
    """anchors with cluster and block: clusters from a bounded sample, all anchors assigned; small clusters share a block, large ones have several.

    Which cluster an anchor is in decides how early its walks end, never what they find.
    """
    n = anchors.count()
    centres, dim = _centres(anchors, n)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = np.full(batch.num_rows, -1, np.int32)
            fits = np.flatnonzero(batch.column("dim").to_numpy() == dim)
            if len(fits) and len(centres):
                flat = np.asarray(batch.column("vector").take(pa.array(fits)).flatten(), float).reshape(len(fits), dim)
                cluster[fits] = (flat @ centres.T).argmax(1)
            yield batch.append_column("cluster", pa.array(cluster))

    out = written(anchors.mapInArrow(assign, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema) + ", cluster int"))
    first, block, room = [], 0, BLOCK_ANCHORS
    for row in out.groupBy("cluster").count().orderBy("cluster").collect():  # at most MOST_CLUSTERS + 1 rows
        if row["count"] > room and room < BLOCK_ANCHORS:
            block, room = block + 1, BLOCK_ANCHORS
        pieces = -(-row["count"] // BLOCK_ANCHORS)
        first.append((row["cluster"], block, pieces))
        if pieces > 1:
            block, room = block + pieces, BLOCK_ANCHORS
        else:
            room -= row["count"]
    where = anchors.sparkSession.createDataFrame(first, "cluster int, first_block int, pieces int")
    own = (F.col("first_block") + F.pmod(F.xxhash64("id"), F.col("pieces"))).cast("int")
    return out.join(F.broadcast(where), "cluster").withColumn("block", own).drop("first_block", "pieces")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of every anchor and target; a limit in each task comes before the shuffle."""
    order = Window.partitionBy("anchor", "target").orderBy(F.desc("score"), "id")
    return found.where("target >= 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(rows: DataFrame, asked: DataFrame, k: int, same: bool, walked: list | None) -> DataFrame:
    """(anchor, target, id, score, rank) of the k best rows of each target's band. asked has low and high, arrays by target."""
    shards = max(1, -(-rows.count() // (SHARD_ROWS // 2)))
    blocks = (asked.agg(F.max("block")).first()[0] or 0) + 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    best, done, many = None, 0, 1
    while done < shards:
        upto = min(shards, done + many)
        now = asked
        if best is not None:  # a search need not look for less than it has
            kth = best.groupBy(F.col("anchor").alias("id"), "target").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth")).where("kth is not null")
            kth = kth.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("target").cast("int"), "kth"))).alias("kth"))
            raised = F.transform("low", lambda x, i: F.greatest(x, 100.0 * F.coalesce(F.try_element_at("kth", i), F.lit(float("-inf")))))
            now = asked.join(kth, "id", "left").withColumn("low", F.when(F.col("kth").isNull(), F.col("low")).otherwise(raised)).drop("kth")
        some = rows.where((F.col("part") >= done) & (F.col("part") < upto)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        now = now.withColumn("part", F.explode(F.sequence(F.lit(done), F.lit(upto - 1))))
        found = some.groupBy("dim", "part", "block").cogroup(now.groupBy("dim", "part", "block")).applyInArrow(
            lambda shard, block: _search(shard, block, k, same), _FOUND
        )
        if walked is not None:
            found = written(found)
            walked.append(found.where("target < 0").agg(F.sum("score"), F.sum("id")).first())
        all_found = found if best is None else found.unionByName(best.drop("rank"))
        before, best = best, written(_best(all_found, k))
        forget(before)
        if walked is not None:
            forget(found)
        done, many = upto, upto * SPREAD
    return best


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, walked: list | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the best rows of other labels in each band.

    rows: id long, label, vector array<long>; anchor: the condition that makes a row an anchor. Rows with a null id, label or vector
    take no part; an id that occurs again counts once, with its smallest vector and label. Higher scores come first, ties go to
    smaller ids; an anchor without a positive, or a positive with an empty band (its score is negative), has no rows, and fewer
    rows than asked for are all there are. Only vectors of one length meet. `walked` gets pairs (scores made, scores possible).

    A stated query set (the anchors) against all rows, in blocks: a shard goes to each block of anchors, all of bounded size.
    """
    rows = rows.where("id is not null and label is not null and vector is not null").groupBy("id").agg(F.min(F.struct("vector", "label")).alias("x"))
    rows = written(rows.select("id", F.col("x.label").cast("long").alias("label"), F.col("x.vector").alias("vector"), F.size("x.vector").alias("dim")))
    anchors = written(clustered(rows.where(anchor)))
    any_score = {"low": F.array(F.lit(float("-inf"))), "high": F.array(F.lit(float("inf")))}
    first = _searched(rows, anchors.withColumns(any_score), positives, True, walked)
    first = first.select("anchor", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    given = first.groupBy(F.col("anchor").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "positive_score"))).alias("of"))
    each = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.try_element_at("of", i))
    nothing = F.lit(float("inf"))
    bands = {  # a negative positive score makes an empty band, as its low end is above its high end
        "low": F.transform(each, lambda s: F.when(s >= 0, s * float(LOW)).otherwise(nothing)),
        "high": F.transform(each, lambda s: F.when(s >= 0, s * float(HIGH)).otherwise(-nothing)),
    }
    second = _searched(rows, anchors.join(given, "id").withColumns(bands).drop("of"), negatives, False, walked)
    second = second.select("anchor", (F.col("target") + 1).cast("int").alias("of"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = second.join(first.withColumnRenamed("rank", "of"), ["anchor", "of"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
