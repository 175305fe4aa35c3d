"""Near-duplicate documents by min-max hashing, banding and exact confirmation on full shingle sets.

Every permutation of the shingles gives two signature values, its minimum and its maximum, so half as many
permutations are evaluated as values kept. Bands of ROWS values collide for similar sets. Documents with the same
set are one class from the start; classes that meet in a band are linked to the band's smallest class, each link is
confirmed on the full sets, and only bands whose classes are not yet connected are looked at again, pair by pair in
blocks. So no group of copies is expanded into pairs, and no link between different texts is lost to a star's centre.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.textkernel import Words, mix, odd_numbers, steps, text_parts
from lociweave.operators.components import components
from lociweave.sources.scratch import written

WIDTH = 5
#: Linked if LEAST[1] * intersection >= LEAST[0] * union.
LEAST = (75, 100)
#: BANDS of ROWS signature values, half of them minima and half maxima of BANDS * ROWS / 2 permutations. A pair at
#: similarity 0.75 shares no band with a chance of (1 - 0.75 ** 5) ** 56 = 3e-7; at 0.8 it is 2e-10.
BANDS, ROWS = 56, 5
PERMUTATIONS = BANDS * ROWS // 2
#: Members and shingles of a block, about, when a band's classes are compared pair by pair, and shingles counted at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 250_000, 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct 5-word shingles of each text, words with A-Z lower-cased.

    A text of fewer words has its whole sequence as one shingle, one without words none.
    """
    words = Words(data, offsets, lower=True)
    h, n = words.hashes(), np.diff(words.bounds)
    factors = odd_numbers(WIDTH, 5)
    ext = np.concatenate([h, np.zeros(WIDTH, np.uint64)])
    total = np.zeros(len(h), np.uint64)
    left = np.repeat(words.bounds[1:], n) - np.arange(len(h))  # words up to the end of the text
    for i in range(WIDTH):
        total += np.where(left > i, ext[i : i + len(h)], np.uint64(0)) * factors[i]
    length = np.minimum(np.repeat(n, n), WIDTH).astype(np.uint64)
    total = mix(total + length * np.uint64(0xD6E8FEB86659FD93))
    begins = np.arange(len(h)) == np.repeat(words.bounds[:-1], n)
    keep = (left >= WIDTH) | (begins & (np.repeat(n, n) < WIDTH))
    owner = np.repeat(np.arange(len(n)), n)[keep]
    total = total[keep]
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    if len(total):
        new = np.ones(len(total), bool)
        new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
        total, owner = total[new], owner[new]
    return total, np.searchsorted(owner, np.arange(len(n) + 1))


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of all permutations (rows) for each non-empty set (columns)."""
    starts = bounds[:-1]
    mins = np.empty((PERMUTATIONS, len(starts)), np.uint64)
    maxs = np.empty_like(mins)
    shift = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64))
    for i, factor in enumerate(odd_numbers(PERMUTATIONS, 11)):
        permuted = (shingles ^ shift[i]) * factor
        mins[i] = np.minimum.reduceat(permuted, starts)
        maxs[i] = np.maximum.reduceat(permuted, starts)
    return np.concatenate([mins, maxs])


def signature_bands(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Band hashes (BANDS columns) of each non-empty set."""
    # a band takes minima only or maxima only, of different permutations: its rows are independent
    values = signatures(shingles, bounds).reshape(BANDS, ROWS, -1)
    bands = np.zeros((BANDS, values.shape[2]), np.uint64)
    for i, factor in enumerate(odd_numbers(ROWS, 13)):
        bands += mix(values[:, i]) * factor
    return mix(bands + np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)).T


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, the set's two digests and its bands (empty for an empty set)."""
    for batch in batches:
        for part in steps(batch):
            shingles, bounds = shingle_sets(*text_parts(part.column("text")))
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            some = np.concatenate([bounds[:-1][full], bounds[-1:]]).astype(np.int64)
            digests = np.zeros((2, len(size)), np.uint64)
            bands = np.zeros((0, BANDS), np.uint64)
            if len(full):
                for d, seed in enumerate((0x1B873593, 0x2545F491)):
                    digests[d, full] = np.add.reduceat(mix(shingles + np.uint64(seed)), some[:-1])
                bands = signature_bands(shingles, some)
            ends = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(size.astype(np.int64)),
                    pa.array(digests[0].view(np.int64)),
                    pa.array(digests[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64))),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"],
            )


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    """Whether two sorted sets reach the similarity, in whole numbers."""
    small, large = sorted((len(a), len(b)))
    if least[1] * small < least[0] * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return least[1] * both >= least[0] * (len(a) + len(b) - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (a, b) of those rows whose texts (text of a, text of b) are linked; rows come with equal b together."""
    for batch in batches:
        for part in steps(batch):
            a, a_at = shingle_sets(*text_parts(part.column("text")))
            other = part.column("other").dictionary_encode()
            b, b_at = shingle_sets(*text_parts(other.dictionary))
            which = np.asarray(other.indices)
            ok = [similar(a[a_at[i] : a_at[i + 1]], b[b_at[j] : b_at[j + 1]]) for i, j in enumerate(which)]
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (a, b) with the texts of both ends; hot ends are split by adaptive execution."""
    text = docs.select(F.col("doc_id").alias("a"), "text")
    other = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("other"))
    return pairs.join(text, "a").join(other, "b").select("a", "b", "text", "other")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (a, b of doc_id) that are linked on their full sets."""
    return _with_texts(pairs, docs).mapInArrow(_confirmed, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, bands and class: the smallest id with the same shingle set (null for an empty set)."""
    described = written(
        docs.select("doc_id", "text").mapInArrow(_described, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")
    )
    key = ["n_shingles", "d1", "d2"]
    sets = described.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # written, so that both sides of the join are plain exchanges, whose hot keys adaptive execution splits
    sets = written(sets.where("n > 1").drop("n"))
    own = F.when(F.col("n_shingles") > 0, F.coalesce("first", "doc_id"))
    return described.join(sets, key, "left").select("doc_id", "n_shingles", "bands", own.alias("class"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links reach, itself included) and kept of every document.

    docs: doc_id long, text; other columns are ignored. Documents are linked at a Jaccard similarity of 0.75 or more of
    their sets of distinct 5-word shingles (64-bit hashes of them). Null, empty and word-free texts have an empty set and
    link with nothing. Rows that repeat an id are taken as one row if their texts are equal; else the smallest text counts.
    Rows with a null id give a row of their own with a null component that is kept. An empty table gives no rows.
    """
    nameless = docs.where("doc_id is null").select("doc_id", "text")
    docs = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text")) if _repeats(docs) else docs.where("doc_id is not null")
    docs = docs.select("doc_id", "text")
    known = written(classes(docs))
    members = known.where("doc_id = class").select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "value"))
    hubs = members.groupBy("band", "value").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("n"))
    hubs = written(hubs.where("n > 1").drop("n"))
    met = written(members.join(hubs, ["band", "value"]).select("band", "value", "doc_id", "hub", "n_shingles"))
    stars = met.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    links = written(confirmed(stars, docs))
    links = links.union(written(_rest(met, links, docs)))
    same = known.where("doc_id <> class").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    found = components(links.select("a", "b").union(same))
    out = known.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    alone = nameless.mapInArrow(_described, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")
    return out.union(alone.select("doc_id", "n_shingles", F.lit(None).cast("long"), F.lit(True)))


def _repeats(docs: DataFrame) -> bool:
    """Whether any id occurs again (ids only are read)."""
    return not docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).isEmpty()


def _rest(met: DataFrame, links: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between classes that share a band but that the stars did not connect.

    Bands whose members are all in one component are done. In the others every two members of different components and
    of fitting sizes are compared, block against block: members are grouped by the order of magnitude of their size (to
    the base 4/3: sets of a similarity of 0.75 are in one magnitude or in neighbours), a magnitude meets itself and
    the one below, and block i meets block j in a task of its own, so a large band is spread over many. A block is cut by
    its members and by their shingles, so long texts make small blocks; there all intersections are counted exactly.
    """
    label = components(links).withColumnRenamed("node", "doc_id")
    open_ = met.join(label, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    mixed = written(
        open_.groupBy("band", "value")
        .agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"))
        .where("low < high")
        .select("band", "value")
    )
    rows = written(open_.join(mixed, ["band", "value"]).drop("hub"))
    # a band's members may be the same as another's: one of the equal groups is enough
    alike = rows.groupBy("band", "value").agg(
        F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")
    )
    first = written(alike.groupBy("s", "n").agg(F.min(F.struct("band", "value")).alias("g")).select("g.band", "g.value"))
    key = ["band", "value", "magnitude"]
    own = F.floor(F.log("n_shingles") / F.log(F.lit(LEAST[1] / LEAST[0])) + 1e-9).cast("int")
    rows = rows.join(first, ["band", "value"]).withColumn(
        "level", F.explode(F.array(F.struct(own.alias("magnitude"), F.lit(True).alias("own")), F.struct((own + 1).alias("magnitude"), F.lit(False).alias("own"))))
    )
    rows = written(rows.select("band", "value", "level.magnitude", "level.own", "doc_id", "component_id", "n_shingles"))
    # a group is of use only if it has members of its own magnitude and different components
    sizes = rows.groupBy(*key).agg(
        F.max("own").alias("has_own"),
        F.min("component_id").alias("low"),
        F.max("component_id").alias("high"),
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
    )
    sizes = written(sizes.where("has_own and low < high").select(*key, "blocks"))
    rows = rows.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        *key, F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "doc_id", "component_id", "own", "block"
    )
    return rows.join(docs, "doc_id").groupBy(*key, "i", "j").applyInArrow(_block_links, "a long, b long").distinct()


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of all left with all right sets: products of 0/1 matrices, some columns at a time."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.r_[False, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, int)
    shared = np.bincount(column) > 1 if len(flat) else np.zeros(0, bool)  # what one set alone has meets nothing
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    edges = np.searchsorted(column, np.arange(0, column[-1] + 1 + COLUMNS, COLUMNS)) if len(column) else [0]
    for k, (start, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[start:end], column[start:end] - k * COLUMNS] = 1
        out += has[left] @ has[right].T
    return out.astype(np.int64)


def _block_links(rows: pa.Table) -> pa.Table:
    """Linked pairs of different components in one pair of blocks."""
    ids, label = rows["doc_id"].to_numpy(), rows["component_id"].to_numpy()
    block, i, j = rows["block"].to_numpy(), rows["i"][0].as_py(), rows["j"][0].as_py()
    sets: list[np.ndarray] = []
    for batch in rows.select(["text"]).to_batches():
        for part in steps(batch):
            h, at = shingle_sets(*text_parts(part.column("text")))
            sets += [h[at[k] : at[k + 1]] for k in range(len(at) - 1)]
    size, own = np.array([len(s) for s in sets]), rows["own"].to_numpy(zero_copy_only=False)
    left, right = (np.flatnonzero(block == i), np.flatnonzero(block == j))
    both = intersections(sets, left, right)
    total = size[left][:, None] + size[right]
    linked = (LEAST[1] * both >= LEAST[0] * (total - both)) & (label[left][:, None] != label[right]) & (own[left][:, None] | own[right])
    x, y = np.nonzero(linked)
    x, y = ids[left[x]], ids[right[y]]
    found = sorted({(max(a, b), min(a, b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)})
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
