"""Vectorised words and word hashes of whole Arrow text columns, as used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step takes; longer texts are a step of their own.
STEP_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


_NEAR = 64
_BYTE_AT = mix(np.arange(_NEAR * 256, dtype=np.uint64) + np.uint64(0x51_7C_C1_B7 << 24)).reshape(_NEAR, 256)


def steps(batch: pa.RecordBatch, text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, or one row where a text is longer."""
    lengths = text_parts(batch.column(text))[1]
    start = 0
    while start < batch.num_rows:
        upto = int(np.searchsorted(lengths, lengths[start] + most, "right")) - 1
        upto = min(batch.num_rows, max(start + 1, upto))
        yield batch.slice(start, upto - start)
        start = upto


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty. Text i is bytes[offsets[i]:offsets[i + 1]]."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a text column.

    starts, ends: byte ranges of all words; bounds: words of text i are numbers bounds[i] to bounds[i + 1].
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        edges = np.zeros(len(data) + 1, bool)  # a text ends the word of the one before
        edges[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        first = inside & (~before | edges[:-1])
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        last = inside & (~after | edges[1:])
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: sums of mixed (place, byte) numbers, mixed with the length."""
        if not len(self):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        letters = self.data[self._inside]
        begins = np.cumsum(lengths) - lengths
        place = np.arange(len(letters)) - np.repeat(begins, lengths)
        value = _BYTE_AT[np.minimum(place, _NEAR - 1), letters]
        far = np.flatnonzero(place >= _NEAR)
        if len(far):
            value[far] = mix(place[far].astype(np.uint64) * np.uint64(256) + letters[far])
        return mix(np.add.reduceat(value, begins) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def windows(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of each run of `width` neighbouring hashes, its order included."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, factor in enumerate(odd_numbers(width, seed)):
        total += hashes[i : i + n] * factor
    return mix(total)
