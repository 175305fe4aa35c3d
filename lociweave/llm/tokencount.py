"""Token counts of a lower-casing word BPE by rank-synchronous merging over ragged arrays.

The words of a step that were not seen before are one flat array of symbols with the bounds of each word. In each round
every word finds the lowest rank among its neighbouring pairs and merges all pairs of that rank at once; words without
a pair are finished. Symbols that survive are counted, and a text's tokens are the sum over its words.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lociweave.llm.textkernel import steps

#: Words that a task remembers at most; then it starts anew.
REMEMBERED = 300_000
STEP_BYTES = 2_000_000
#: Characters that every version of Unicode normalises, lower-cases and classes alike. Texts with others are normalised and
#: cut by the library's own tables, as those of Python may be of another version.
STABLE = regex.compile(r"[\x00-\u0130\u0132-\u02af\u0400-\u0481\u048a-\u04ff\u2010-\u2027\u2030-\u2044\u20ac\u2122\u3041-\u3093\u30a1-\u30f6\u4e00-\u9fa5]*")
_NEVER = np.int64(1 << 62)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next code points from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordCounter:
    """The merges of a tokenizer file as sorted pairs, and the counts of remembered words."""

    def __init__(self, file: bytes):
        made = json.loads(file)
        kinds = [n["type"] for n in made["normalizer"]["normalizers"]]
        split = made["pre_tokenizer"]["pretokenizers"][0]
        if made["model"]["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
            raise ValueError("not a lower-casing word BPE: its normaliser or splitter differs")
        model = made["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.size = max(vocab.values()) + 1
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right, made_of = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.merged = key[order], order.astype(np.int64), made_of[order]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + self.end] for c in letters], np.int64)
        self.split = regex.compile(split["pattern"]["Regex"])
        self.library = Tokenizer.from_str(file.decode())
        special = [t["content"] for t in made["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def merged_counts(self, words: list[bytes]) -> np.ndarray:
        """How many symbols of each word survive all merges."""
        sizes = np.array([len(w) for w in words], np.int64)
        counts = np.zeros(len(words), np.int64)
        if not len(words):
            return counts
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[flat]
        last = np.cumsum(sizes) - 1
        symbol[last[sizes > 0]] = self.final[flat[last[sizes > 0]]]
        owner = np.repeat(np.arange(len(words)), sizes)
        while len(symbol):
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            fits = (self.key[at] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(fits, self.rank[at], _NEVER), _NEVER)
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, begins)
            lengths = np.diff(np.append(begins, len(symbol)))
            done = lowest == _NEVER
            counts[owner[begins[done]]] = lengths[done]
            low = np.repeat(lowest, lengths)
            hit = (rank == low) & (low != _NEVER)
            # of pairs that overlap (runs of one symbol) every second is merged, from the left
            place = np.arange(len(hit))
            run = hit & ~np.r_[False, hit[:-1]]
            begin = np.maximum.accumulate(np.where(run, place, -1))
            hit &= (place - begin) % 2 == 0
            where = np.flatnonzero(hit)
            symbol[where] = self.merged[at[where]]
            keep = np.repeat(~done, lengths)
            keep[where + 1] = False
            symbol, owner = symbol[keep], owner[keep]
        return counts

    def words(self, text: str) -> tuple[list[str], int]:
        """(words of a text, special tokens in it)."""
        if self.special is None or "<|" not in text and not self.special.search(text):
            return self._cut(text), 0
        parts = self.special.split(text)
        return list(chain.from_iterable(map(self._cut, parts))), len(parts) - 1

    def _cut(self, text: str) -> list[str]:
        if text.isascii():
            return self.split.findall(text.lower())
        if STABLE.fullmatch(text):
            return self.split.findall(unicodedata.normalize("NFC", text).lower())
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, texts: list[str]) -> np.ndarray:
        """The tokens of each text."""
        cut = [self.words(t) for t in texts]
        distinct = set(chain.from_iterable(w for w, _ in cut))
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(distinct)
        self.known.update(zip(new, self.merged_counts([w.encode("utf-8", "replace") for w in new]).tolist(), strict=True))
        find = self.known.__getitem__
        return np.array([sum(map(find, w)) + special for w, special in cut], np.int64)


def counted(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """`docs` (with text) plus n_bytes (UTF-8) and n_tokens of each whole text; null counts as empty: 0 and 0.

    Special strings in a text are special tokens, as the tokenizer's library does by default; nothing is added, cut or
    padded. Other columns, whatever their names, pass through untouched, repeated rows too; an empty table gives no rows.
    The file is read on the driver and broadcast, as it is of fixed size.
    """
    with open(tokenizer_file, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    added = ("n_bytes", "n_tokens")
    docs = docs.drop(*added)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(sent.value)  # a task's own: nothing outlives it
        for batch in batches:
            for part in steps(batch, most=STEP_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n_bytes = np.array([len(t.encode()) for t in texts], np.int64)
                columns = [*[part.column(name) for name in names], pa.array(n_bytes), pa.array(counter.count(texts))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return docs.mapInArrow(run, f"{schema}, n_bytes long, n_tokens long")
