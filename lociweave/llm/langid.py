"""Language identification with one bit-sliced Bloom filter whose slots are bitmasks of languages, a word for each 64.

Training counts byte n-grams by language over all training documents, keeps in each language the n-grams that are
frequent there, and sets that language's bit in the n-gram's slots. Looking an n-gram up is one AND over its slots,
which gives all languages that contain it at once. A document's hits are counted by language; from each count the
hits that the filter's fill would give by chance are taken off, and the language with the largest share wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.llm.textkernel import mix, steps, text_parts
from lociweave.sources.scratch import forget, written

#: Bytes of an n-gram.
GRAM = 4
#: Slots of the filter (a power of two) and probes of an n-gram: the filter has 8 * SLOTS bytes for each WORD languages.
SLOTS = 1 << 18
PROBES = 3
#: An n-gram belongs to a language if it makes at least this share of its n-grams.
LEAST_SHARE = 2e-5
#: Languages that one word of a mask holds; a slot has as many words as all languages need.
WORD = 64
#: n-grams that are looked up at once, which bounds a step's memory whatever the number of words.
LOOKED_UP = 1 << 18
#: A share of fewer n-grams than this says nothing about a text.
LEAST_GRAMS = 8
#: Blanks put before and after each text, so that the shortest words have n-grams.
PAD = 2
#: Bytes of text that one step of counting or looking up takes.
STEP_BYTES = 500_000
#: Predicted where there is nothing to read: null text or no letter.
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[[*range(0x09, 0x0E)]] = 0x20
_FOLD[[*range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20


def has_letter(text: Column) -> Column:
    """Whether a text has a letter of any script; false for null."""
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram numbers, text of each) of a text column; letters lower-cased, digits and punctuation as blanks.

    Each text has PAD blanks around it. n-grams of blanks at both inner places, and those across two texts, are left out.
    """
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 2 * PAD)
    folded = np.full(len(data) + 2 * PAD * len(sizes), 0x20, np.uint8)
    folded[np.arange(len(data)) + np.repeat(np.arange(len(sizes)) * 2 * PAD + PAD, sizes)] = _FOLD[data]
    # upper-case letters of the two-byte Latin range differ from lower-case ones by the same bit as ASCII ones
    second = np.zeros(len(folded), bool)
    second[1:] = (folded[:-1] == 0xC3) & (folded[1:] >= 0x80) & (folded[1:] <= 0x9E) & (folded[1:] != 0x97)
    folded[second] |= 0x20
    n = len(folded) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    codes = np.zeros(n, np.uint32)
    for i in range(GRAM):
        codes <<= np.uint32(8)
        codes |= folded[i : i + n]
    fit = (owner[:n] == owner[GRAM - 1 :]) & ~((folded[1 : n + 1] == 0x20) & (folded[2 : n + 2] == 0x20))
    return codes[fit], owner[:n][fit]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n) of the n-grams of a task's texts, added up step by step."""
    for batch in batches:
        for part in steps(batch, most=STEP_BYTES):
            codes, owner = grams(*text_parts(part.column("text")))
            lang = part.column("lang").dictionary_encode()
            which = np.asarray(lang.indices).astype(np.uint64)
            keys, n = np.unique((which[owner] << np.uint64(32)) | codes, return_counts=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": lang.dictionary.take(pa.array((keys >> np.uint64(32)).astype(np.int64))).cast(pa.string()),
                    "code": (keys & np.uint64(0xFFFFFFFF)).astype(np.int64),
                    "n": n.astype(np.int64),
                }
            )


def probes(codes: np.ndarray) -> np.ndarray:
    """The slots of each n-gram, PROBES rows."""
    spread = mix(codes.astype(np.uint64) + np.uint64(0x7F4A7C15))
    step = (spread >> np.uint64(40)) | np.uint64(1)
    return np.stack([((spread + np.uint64(i) * step) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(PROBES)])


@dataclass(frozen=True)
class LanguageFilter:
    """The learned languages in bit order and the mask words of each slot (SLOTS rows): language i is bit i % WORD of word i // WORD.

    usual: the number of the language with most n-grams, which is predicted where no n-gram is known.
    """

    langs: tuple[str, ...]
    masks: np.ndarray
    usual: int = 0

    @property
    def by_chance(self) -> np.ndarray:
        """For each language the chance that an n-gram of none hits all its slots: fill to the power of the probes."""
        fill = np.array([_bit(self.masks, i).mean() for i in range(len(self.langs))])
        return fill**PROBES

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts by languages: the share of n-grams that the language explains, chance hits taken off, 0 to 1."""
        return self.judged(data, offsets)[0]

    def judged(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shares, n-grams of each text): shares of few n-grams say little about a text."""
        codes, owner = grams(data, offsets)
        n = len(offsets) - 1
        total = np.bincount(owner, minlength=n)
        out = np.zeros((n, len(self.langs)))
        for start in range(0, len(codes), LOOKED_UP):
            slots = probes(codes[start : start + LOOKED_UP])
            of = owner[start : start + LOOKED_UP]
            mask = self.masks[slots[0]]
            for row in slots[1:]:
                mask &= self.masks[row]
            first, last = of[0], of[-1] + 1
            for i in range(len(self.langs)):
                out[first:last, i] += np.bincount(of[_bit(mask, i)] - first, minlength=last - first)
        for i, chance in enumerate(self.by_chance):
            hits = out[:, i]
            out[:, i] = np.clip((hits - total * chance) / (np.maximum(total, 1) * (1 - chance)), 0, 1) if chance < 1 else 0
        return out, total


def _bit(masks: np.ndarray, i: int) -> np.ndarray:
    """Whether each row of mask words has language i."""
    return (masks[:, i // WORD] >> np.uint64(i % WORD)) & np.uint64(1) == 1


def learned(docs: DataFrame) -> LanguageFilter:
    """The filter of all documents in `docs` (text, lang); rows with a null text or lang teach nothing.

    Counting is done in every task for its own texts, then summed by key; only the names of the languages and the
    finished masks, SLOTS numbers for each WORD languages, reach the driver. No document is left out or sampled, and no
    language with an n-gram that is frequent in it. Without any text no language is learned.
    """
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = rows.mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(totals, "lang").where(F.col("n") >= F.greatest(F.lit(2.0), F.col("total") * LEAST_SHARE))
    frequent = written(frequent.select("lang", "code", "n"))
    # one short row for each language: languages are a label set, not a measure of the corpus
    sizes = {r["lang"]: r["n"] for r in frequent.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = tuple(sorted(sizes))
    masks = np.zeros((SLOTS, max(1, -(-len(langs) // WORD))), np.uint64)
    if langs:
        # the bits as signed longs: the last bit of a word is the smallest one
        places = [(lang, i // WORD, 1 << i % WORD if i % WORD < WORD - 1 else -(1 << WORD - 1)) for i, lang in enumerate(langs)]
        places = docs.sparkSession.createDataFrame(places, "lang string, word int, bit long")
        lit = frequent.join(F.broadcast(places), "lang").select("code", "word", "bit")
        slots = lit.mapInArrow(_lit_slots, "slot int, word int, bit long").groupBy("slot", "word").agg(F.bit_or("bit").alias("mask"))
        rows = slots.toArrow()
        masks[rows["slot"].to_numpy(), rows["word"].to_numpy()] = rows["mask"].to_numpy().astype(np.int64).view(np.uint64)
    usual = max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i), default=0)
    forget(frequent)
    return LanguageFilter(langs, masks, usual)


def _lit_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = probes(batch.column("code").to_numpy())
        yield pa.RecordBatch.from_pydict(
            {"slot": slots.ravel().astype(np.int32)} | {name: np.tile(batch.column(name).to_numpy(), PROBES) for name in ("word", "bit")}
        )


def identified(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """`docs` (with text) plus lang_pred string, score double (0 to 1) and lang_share double.

    score is the winner's part of all languages' shares; lang_share is the winner's own share, low for text that no
    language explains. Null texts and texts without a letter get `und` and 0; texts with letters but without a known
    n-gram get the most frequent language and score 0 (no language learned at all: `und`). lang_share is null where a text
    with letters has fewer than LEAST_GRAMS n-grams: too little to hold it against a language. Whole texts are read; other
    columns, whatever their names, pass through untouched, but for those of the three names added.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.langs, model.masks.tobytes(), model.usual))  # 8 * SLOTS bytes for each WORD languages
    added = ("lang_pred", "score", "lang_share")
    docs = docs.drop(*added)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    names = docs.columns
    mark = "readable" + "_" * max(map(len, names))  # a name that no column has
    rows = docs.withColumn(mark, has_letter(F.col("text")))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, raw, usual = sent.value
        known = LanguageFilter(langs, np.frombuffer(raw, np.uint64).reshape(SLOTS, -1), usual)
        labels = pa.array([*langs, UNKNOWN], pa.string())
        for batch in batches:
            for part in steps(batch, most=STEP_BYTES):
                readable = np.asarray(part.column(mark))
                if langs:
                    shares, total = known.judged(*text_parts(part.column("text")))
                    best = np.where(shares.any(1), shares.argmax(1), usual)
                    top = shares[np.arange(len(best)), best]
                    score = top / np.maximum(shares.sum(1), 1e-12)
                else:
                    best, top, score = np.zeros(len(readable), int), np.zeros(len(readable)), np.zeros(len(readable))
                    readable, total = np.zeros(len(readable), bool), np.zeros(len(readable), int)
                best = np.where(readable, best, len(langs))
                columns = [part.column(name) for name in names]
                columns += [
                    labels.take(pa.array(best)),
                    pa.array(np.where(readable, np.clip(score, 0, 1), 0.0)),
                    pa.array(np.where(readable, top, 0.0), mask=readable & (total < LEAST_GRAMS)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return rows.mapInArrow(predict, f"{schema}, lang_pred string, score double, lang_share double")
