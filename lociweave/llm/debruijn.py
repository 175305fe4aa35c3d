"""Repeated spans by a compacted de Bruijn graph of token k-mers.

A window is SPAN consecutive words; it is removed where the same word sequence starts earlier (smaller doc_id, or
earlier in the same document). The work is done on sampled k-mers instead of on every window:

1. Each window names its smallest k-mer by hash, leftmost on ties, so equal windows name equal k-mers: these are the
   graph's nodes, one for about (SPAN - K + 2) / 2 words. Counting nodes drops everything that occurs once.
2. A repeated node's occurrence carries a 64-bit hash of its context (all words of the windows that named it). Where all
   occurrences of a node have one context the path does not branch there: all its windows are the same everywhere and
   the first coordinate decides for them together. A join with the first coordinates compacts neighbouring nodes of
   a path into spans (document, shift against the source) with begin and end.
3. At branching nodes, the ends of passages, the windows themselves become edges (128-bit hashes of all words); the
   first coordinate of each edge decides for it.
4. Spans of one document and shift that touch are joined. The words at each span's source coordinates are read and
   digested; a span goes to its document with that digest, and words are cut only where the document's own agree with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lociweave.llm.textkernel import Words, mix, odd_numbers, steps, text_parts, windows
from lociweave.sources.scratch import written

#: Words of a window, and of a node's k-mer.
SPAN, K = 20, 6
_BASE = np.uint64(0xA24BAED4963EE407)
_BASE_INVERSE = np.uint64(pow(0xA24BAED4963EE407, -1, 2**64))


def nodes(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer hash, place, first window, last window) of all nodes; places and windows count over all texts.

    h: word hashes; words of text i are numbers bounds[i] to bounds[i + 1]. A node's windows are neighbours.
    """
    kmers = windows(h, K, 17)
    none = np.zeros(0, np.int64)
    if len(h) < SPAN:
        return np.zeros(0, np.uint64), none, none, none
    n = len(h) - SPAN + 1
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(owner[:n] == owner[SPAN - 1 :])  # windows within one text
    best, at = kmers[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, SPAN - K + 1):
        other = kmers[j : j + n]
        less = other < best
        best[less] = other[less]
        at[less] = j
    place = starts + at[starts]
    if not len(place):
        return np.zeros(0, np.uint64), none, none, none
    # the leftmost smallest k-mer of later windows is never further left, so equal places are neighbours
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[new[1:], len(place)] - 1
    return kmers[place[new]], place[new], starts[new], starts[last]


class RangeHash:
    """128-bit hashes of ranges of a hash sequence."""

    def __init__(self, h: np.ndarray):
        power = np.cumprod(np.full(len(h) + 1, _BASE))  # powers 1 to n + 1
        self._back = np.cumprod(np.full(len(h) + 1, _BASE_INVERSE))
        self._sums = [np.r_[np.uint64(0), np.cumsum(x * power[: len(h)])] for x in (h, mix(h + np.uint64(0x632BE59B)))]

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> list[np.ndarray]:
        """Two hashes of each range; ranges of different salts never count as equal."""
        salt = mix(salt.astype(np.uint64) + (end - start).astype(np.uint64) * np.uint64(1 << 32))
        return [mix((s[end] - s[start]) * self._back[start] + salt) for s in self._sums]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, doc_id, place (word number of the k-mer and of the windows' reach, packed) and context of all nodes."""
    for batch in batches:
        for part in steps(batch):
            words = Words(*text_parts(part.column("text")))
            h = words.hashes()
            node, place, first, last = nodes(h, words.bounds)
            if not len(node):
                continue
            text = np.searchsorted(words.bounds, place, "right") - 1
            one, two = RangeHash(h).of(first, last + SPAN, place - first)
            yield pa.RecordBatch.from_arrays(
                [
                    _long(node),
                    part.column("doc_id").take(pa.array(text)),
                    _long((first - words.bounds[text]) << 8 | (last - first)),
                    _long(one ^ mix(two)),
                ],
                names=["node", "doc_id", "reach", "context"],
            )


_OCCURRENCES = "node long, doc_id long, reach long, context long"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """e1, e2, doc_id, start of the windows in `reaches` of each text."""
    for batch in batches:
        for part in steps(batch):
            words = Words(*text_parts(part.column("text")))
            reaches = part.column("reaches")
            where = np.asarray(reaches.value_lengths())
            text = np.repeat(np.arange(len(where)), where)
            reach = reaches.flatten().to_numpy()
            count = (reach & 255) + 1
            begin = np.repeat((reach >> 8) + words.bounds[text], count)
            start = begin + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            text = np.repeat(text, count)
            one, two = RangeHash(words.hashes()).of(start, start + SPAN, np.zeros(len(start)))
            yield pa.RecordBatch.from_arrays(
                [_long(one), _long(two), part.column("doc_id").take(pa.array(text)), _long(start - words.bounds[text])],
                names=["e1", "e2", "doc_id", "start"],
            )


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], mark: str, rewrite: bool) -> Iterator[pa.RecordBatch]:
    """Each document's counts and digest, or with `rewrite` its row with the shortened text."""
    for batch in batches:
        for part in steps(batch):
            data, offsets = text_parts(part.column("text"))
            words = Words(data, offsets)
            n = np.diff(words.bounds)
            raw = data.tobytes()
            spans = part.column(mark)
            many = np.asarray(spans.value_lengths().fill_null(0))
            text = np.repeat(np.arange(len(many)), many)
            flat = spans.flatten()
            # a row whose id has another text too may be shorter than the ranges
            begin, end = (np.minimum(flat.field(name).to_numpy(zero_copy_only=False), n[text]) + words.bounds[text] for name in ("begin", "end"))
            # only where the words are those at the source coordinates
            same = np.fromiter(map(bytes.__eq__, range_digests(words, raw, begin, end), flat.field("digest").to_pylist()), bool, len(begin))
            marks = np.zeros(len(words) + 1, np.int64)
            np.add.at(marks, begin[same], 1)
            np.add.at(marks, end[same], -1)
            gone = np.cumsum(marks)[:-1] > 0
            removed = np.add.reduceat(np.r_[gone, False], np.minimum(words.bounds[:-1], len(words))) * (n > 0)
            if rewrite:
                texts = part.column("text").to_pylist()
                for i in np.flatnonzero(removed):
                    kept, at = [], int(offsets[i])
                    for w in range(words.bounds[i], words.bounds[i + 1]):
                        if not gone[w]:  # with the white space before it, unless words went there
                            kept.append(raw[at : words.ends[w]] if w == words.bounds[i] or not gone[w - 1] else b" " + raw[words.starts[w] : words.ends[w]])
                        at = int(words.ends[w])
                    texts[i] = b"".join(kept).strip(b" \t\n\v\f\r").decode()
                columns = [pa.array(texts, pa.string()) if name == "text" else part.column(name) for name in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(removed.astype(np.int64))], names=[*names, "n_words", "n_removed"])
                continue
            digests = []
            for i in range(len(n)):
                keep = np.flatnonzero(~gone[words.bounds[i] : words.bounds[i + 1]]) + words.bounds[i]
                digests.append(
                    hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(words.starts[keep], words.ends[keep], strict=True)])).hexdigest()
                )
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(digests)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, begin, end, of, shift): word ranges to remove, and the document that has them earlier at begin - shift.

    Ranges of a document may overlap. texts: doc_id (not null, once), text.
    """
    found = texts.mapInArrow(_occurrences, _OCCURRENCES)
    repeated = written(found.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"))
    found = written(found.join(repeated, "node"))
    first = F.min(F.struct("doc_id", "reach"))
    paths = found.groupBy("node").agg(
        first.alias("source"), (F.min("context") == F.max("context")).alias("straight")
    )
    paths = written(paths)
    placed = found.join(paths, "node")
    here = F.struct("doc_id", "reach")
    straight = placed.where("straight").where(here != F.col("source"))
    begin = F.shiftright("reach", 8)
    end = begin + F.col("reach").bitwiseAND(255) + SPAN
    spans = straight.select("doc_id", begin.alias("begin"), end.alias("end"), F.col("source.doc_id").alias("of"),
                            (begin - F.shiftright("source.reach", 8)).alias("shift"))
    forks = placed.where("not straight").groupBy("doc_id").agg(F.collect_list("reach").alias("reaches"))
    edges = written(
        forks.join(texts, "doc_id").select("doc_id", "text", "reaches").mapInArrow(_edges, "e1 long, e2 long, doc_id long, start long")
    )
    source = edges.groupBy("e1", "e2").agg(F.min(F.struct("doc_id", "start")).alias("source"), F.count(F.lit(1)).alias("n"))
    source = written(source.where("n > 1").drop("n"))
    later = edges.join(source, ["e1", "e2"]).where(F.struct("doc_id", "start") != F.col("source"))
    later = later.select(
        "doc_id", F.col("start").alias("begin"), (F.col("start") + SPAN).alias("end"), F.col("source.doc_id").alias("of"),
        (F.col("start") - F.col("source.start")).alias("shift"),
    )
    return joined(spans.union(later))


def joined(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, begin, end, of, shift) with those that touch made one: neighbours of one path keep their shift."""
    key = ["doc_id", "of", "shift"]
    order = Window.partitionBy(*key).orderBy("begin")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("begin") <= before, 0).otherwise(1)
    runs = spans.withColumn("run", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*key, "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("run")


def range_digests(words: Words, raw: bytes, begins: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """A 128-bit digest of the words of each range (word numbers over all texts), joined by one space."""
    if not len(begins):
        return []
    sizes = words.ends - words.starts
    at = np.r_[0, np.cumsum(sizes + 1)]
    plain = np.full(int(at[-1]), 0x20, np.uint8)
    letters = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    plain[np.repeat(at[:-1], sizes) + letters] = np.frombuffer(raw, np.uint8)[np.repeat(words.starts, sizes) + letters]
    plain = plain.tobytes()
    return [hashlib.blake2b(plain[a:b], digest_size=16).digest() for a, b in zip(at[begins], at[ends] - 1, strict=True)]


def _source_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """of, source_begin, source_end, digest of the ranges of each text."""
    for batch in batches:
        for part in steps(batch):
            data, offsets = text_parts(part.column("text"))
            words = Words(data, offsets)
            ranges = part.column("ranges")
            many = np.asarray(ranges.value_lengths())
            text = np.repeat(np.arange(len(many)), many)
            flat = ranges.flatten()
            begin, end = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("source_begin", "source_end"))
            digests = range_digests(words, data.tobytes(), begin + words.bounds[text], end + words.bounds[text])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(text)), pa.array(begin), pa.array(end), pa.array(digests, pa.binary())],
                names=["of", "source_begin", "source_end", "digest"],
            )


def sourced(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, begin, end, digest): spans with the digest of the words at their source coordinates."""
    spans = written(spans.select("doc_id", "begin", "end", "of", (F.col("begin") - F.col("shift")).alias("source_begin"), (F.col("end") - F.col("shift")).alias("source_end")))
    key = ["of", "source_begin", "source_end"]
    ranges = spans.select(*key).distinct().groupBy(F.col("of").alias("doc_id")).agg(F.collect_list(F.struct("source_begin", "source_end")).alias("ranges"))
    digests = ranges.join(texts, "doc_id").select("doc_id", "text", "ranges").mapInArrow(
        _source_digests, "of long, source_begin long, source_end long, digest binary"
    )
    # written, so that the join has plain exchanges, whose hot keys adaptive execution splits
    return spans.join(written(digests), key).select("doc_id", "begin", "end", "digest")


def _with_spans(docs: DataFrame, mark: str) -> DataFrame:
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    if not texts.groupBy("doc_id").count().where("count > 1").limit(1).isEmpty():
        texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    found = sourced(repeated_spans(texts), texts)
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end", "digest")).alias(mark))
    return docs.join(found, "doc_id", "left")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) of every document.

    docs: doc_id long, text; other columns are ignored. Null, empty and word-free texts have no words. Rows that repeat an
    id are one document with its smallest text, whose ranges are cut from each of them that has the same words there; a null id
    takes part in nothing and keeps all its words. An empty table gives no rows.
    """
    rows = _with_spans(docs.select("doc_id", "text"), "spans")
    return rows.mapInArrow(
        lambda batches: _cut(batches, [], "spans", False), "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )


def rewritten(docs: DataFrame) -> DataFrame:
    """`docs` with repeated words cut from text, plus n_words and n_removed; texts that lose nothing stay as they are.

    Null texts stay null, empty and word-free ones as they are, with 0 words. Rows that repeat an id, and a null id, are taken
    as by `deduplicated`. Where words go, the white space before the next kept word becomes one space, and ASCII white space
    at the ends of the text goes. Other columns, whatever their names, pass through, but for those of the two names added.
    """
    docs = docs.drop("n_words", "n_removed")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    names = docs.columns
    mark = "spans" + "_" * max(map(len, names))  # a name that no column has
    return _with_spans(docs, mark).select(*names, mark).mapInArrow(
        lambda batches: _cut(batches, names, mark, True), f"{schema}, n_words long, n_removed long"
    )
