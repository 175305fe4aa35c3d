"""Benchmark decontamination by a distributed positional inverted index, as DataFrame operations only.

A window is `width` consecutive words of a benchmark item. Words are counted over all documents first; then every window
is found from its rarest words: the index stores the postings (word, document, place) of the two rarest words of each
window, with the words around the place for the rarest one. The lists of these two words are intersected with their offset
taken off, and what is left is compared word by word with the window. Words that many documents share have postings only
where a window has none rarer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.sources.scratch import forget, written

#: Words of a window.
WIDTH = 10
#: Bytes of terms that one broadcast holds; more terms are looked up slice by slice, each in a scan of its own.
MOST_TERM_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every ASCII character that is no digit and no letter ends a word.
_BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z in lower case; none for null."""
    flat = F.trim(F.translate(text, _BREAKS + _UPPER, " " * len(_BREAKS) + _LOWER))
    return F.when(flat != "", F.split(flat, " +")).otherwise(F.array().cast("array<string>"))


def _keyed(docs: DataFrame) -> list[Column]:
    """doc, digest: together they name a row; rows that repeat an id and text have one name, which does no harm."""
    return [F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("digest")]


def _looked_up(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of tokens whose term is in terms (a row for each term). Each slice of terms that is broadcast is of bounded size."""
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    slices = -(-size // MOST_TERM_BYTES)
    out = None
    for i in range(max(1, slices)):
        some = terms.where(F.pmod(F.xxhash64("term"), F.lit(slices)) == i) if slices > 1 else terms
        part = tokens.join(F.broadcast(some), "term")
        out = part if out is None else out.unionByName(part)
    return out


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of terms occurs in all texts; partial counts come before the shuffle."""
    tokens = docs.select(F.explode_outer(words_of(F.col("text"))).alias("term"))
    return _looked_up(tokens, terms).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def postings(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """(term, doc, digest, pos from 0, near) of every occurrence of the given terms in all texts, as a written table.

    terms: term, lead. near holds up to `reach` words on both sides of a lead term, and is null for the others.
    """
    words = docs.select(*_keyed(docs), words_of(F.col("text")).alias("words"))
    tokens = words.select("doc", "digest", "words", F.posexplode_outer("words").alias("pos", "term"))
    at = F.col("pos") + 1
    first = F.greatest(F.lit(1), at - reach)
    near = F.when(F.col("lead"), F.slice("words", first, at + reach - first + 1))
    return written(_looked_up(tokens, terms).select("term", "doc", "digest", "pos", near.alias("near")))


def windows(items: DataFrame, n: DataFrame, width: int, reach: int) -> DataFrame:
    """What to look for: one row for each (rarest word, its surroundings, second rarest word) of the items' windows.

    term, near, at: the rarest word of these windows and the words around it, of which it is number `at`; term2, off: the second
    rarest and its distance; spans: the windows as (start, length) from the rarest word's place; items: whose windows these
    are. Windows of which a word occurs nowhere are left out. n: (term, n) of all words that occur.
    """
    own = items.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    counted = own.select("item_id", "words", F.posexplode("words").alias("i", "term")).join(n, "term", "left")
    each = F.array_sort(F.collect_list(F.struct("i", F.coalesce("n", F.lit(0)).alias("n"), "term")))
    counted = counted.groupBy("item_id", "words").agg(each.alias("each"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))

    def window(s: Column) -> Column:
        rarest = F.array_sort(F.transform(F.slice("each", s, F.lit(width)), lambda x: F.struct(x["n"], x["term"], x["i"])))
        return F.struct(s.alias("s"), F.size(rarest).alias("length"), rarest[0].alias("one"), F.coalesce(F.get(rarest, F.lit(1)), rarest[0]).alias("two"))

    rows = counted.select("item_id", "words", F.explode(F.transform(starts, window)).alias("w")).where("w.one.n > 0")
    at = F.col("w.one.i") + 1
    first = F.greatest(F.lit(1), at - reach)
    rows = rows.select(
        "item_id",
        F.col("w.one.term").alias("term"),
        F.slice("words", first, at + reach - first + 1).alias("near"),
        (at - first + 1).alias("at"),
        F.col("w.two.term").alias("term2"),
        (F.col("w.two.i") - F.col("w.one.i")).alias("off"),
        F.struct((F.col("w.s") - at).alias("start"), F.col("w.length").alias("length")).alias("span"),
        at.alias("place"),
    )
    # windows of one place of an item first, then equal ones of all items: what items share is looked for once
    rows = rows.groupBy("item_id", "term", "near", "at", "term2", "off", "place").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    return rows.groupBy("term", "near", "at", "term2", "off", "spans").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, within: int | None = None) -> DataFrame:
    """(doc, digest, items, spans) for each place of a document where windows occur; a document may have many rows.

    docs: doc_id, text; items: item_id, text; texts may be null. spans: array of (start, length) in words from the document's
    first, 0. An item of fewer than `width` words is one window, items without words or id have none. With `within`, what
    counts is proximity: all words of a window, in any order, in a run of at most `within` words around its rarest one, which
    is the span. doc is the id (0 for null), and digest tells rows of one id apart.
    """
    reach = max(width, within or 0) - 1
    asked = items.select(F.explode(words_of(F.col("text"))).alias("term")).distinct()
    n = written(frequencies(docs, asked))
    wanted = written(windows(items, n, width, reach))
    terms = wanted.select("term", F.lit(True).alias("lead")).union(wanted.select("term2", F.lit(False))).groupBy("term").agg(F.max("lead").alias("lead"))
    index = postings(docs, terms, reach)
    lead = index.where("near is not null").withColumnRenamed("near", "here")
    found = lead.join(wanted, "term")
    other = index.select(*[F.col(c).alias(f"{c}_2") for c in ("term", "doc", "digest", "pos")])
    same = (F.col("term2") == F.col("term_2")) & (F.col("doc") == F.col("doc_2")) & (F.col("digest") == F.col("digest_2"))
    at_here = F.least(F.col("pos"), F.lit(reach)) + 1
    if within is None:
        found = found.join(other, same & (F.col("pos") + F.col("off") == F.col("pos_2")), "left_semi")

        def equal(w: Column) -> Column:
            from_here, from_there = at_here + w["start"], F.col("at") + w["start"]
            return F.when(from_here >= 1, F.slice("here", from_here, w["length"]) == F.slice("near", from_there, w["length"])).otherwise(F.lit(False))

        spans = F.transform(F.filter("spans", equal), lambda w: F.struct((F.col("pos") + w["start"]).cast("long").alias("start"), w["length"].cast("long").alias("length")))
    else:
        found = found.join(other, same & (F.abs(F.col("pos") - F.col("pos_2")) < within), "left_semi")
        starts = F.sequence(F.greatest(F.lit(1), at_here - within + 1), at_here)

        def run_of(w: Column) -> Column:
            terms = F.array_distinct(F.slice("near", F.col("at") + w["start"], w["length"]))
            first = F.get(F.filter(starts, lambda s: F.size(F.array_except(terms, F.slice("here", s, F.lit(within)))) == 0), F.lit(0))
            length = F.least(F.lit(within), F.size("here") - first + 1)
            return F.when(first.isNotNull(), F.struct((F.col("pos") + first - at_here).cast("long").alias("start"), length.cast("long").alias("length")))

        spans = F.filter(F.transform("spans", run_of), lambda x: x.isNotNull())
    out = found.select("doc", "digest", "items", spans.alias("spans")).where(F.size("spans") > 0)
    out.scratch = (n, wanted, index)
    return out


def covered(spans: Column) -> Column:
    """How many words an array of (start, length) covers."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def more(so_far: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        return F.struct((so_far["n"] + F.greatest(F.lit(0), end - F.greatest(so_far["upto"], x["start"]))).alias("n"), F.greatest(so_far["upto"], end).alias("upto"))

    return F.aggregate(F.array_sort(spans), none, more, lambda x: x["n"])


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, within: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of items with occurring windows), spans of every row of docs.

    docs: doc_id, text; items: item_id, text; other columns are ignored. A document word inside any occurrence of a window is
    hit. Null and empty texts have no words and no hits, rows that repeat an id and text have the same result, and rows of one
    id with several texts one each. Empty tables give no rows, or no hits. A document's spans are at most as many as its words.
    """
    hits = matches(docs, items, width, within)
    scratch = hits.scratch
    by_doc = written(hits.groupBy("doc", "digest").agg(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans")
    ))
    for df in scratch:
        forget(df)
    rows = docs.select("doc_id", *_keyed(docs), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast(by_doc.schema["items"].dataType)
    return rows.join(by_doc, ["doc", "digest"], "left").select(
        "doc_id", "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("spans", F.array().cast(by_doc.schema["spans"].dataType)).alias("spans"),
    )
