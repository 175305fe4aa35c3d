"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each Spark partition.

A partition's texts are split into pre-tokens by the tokenizer's pattern. Those not seen before, and that are no token
as a whole, become rows (word, place, token), one for each byte; a recursive query joins neighbours with the merge table
and contracts minimum-rank pairs, leftmost first, until no pair is left. In a word longer than two of the longest tokens
a round contracts the minimum of every neighbourhood instead of that of the whole word, which gives the same ids: what a
pair could lose its tokens to would have to grow from a lower pair nearby. Decoding joins ids with their bytes and
aggregates them in order. The vocabulary reaches the tasks as a broadcast, whose size does not depend on the corpus.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lociweave.llm.textkernel import steps

#: Words that a Python worker remembers at most, some 70 MB; then it forgets those that only one step has met.
REMEMBERED = 400_000
#: Bytes of text encoded and decoded together.
STEP_BYTES = 4_000_000
#: Memory of a task's DuckDB, and what each byte of a longer word than usual adds to it.
MEMORY_MB, BYTES_PER_BYTE = 200, 300

#: Tokens of up to this many bytes bound the neighbourhoods of any word; a word that contains longer ones has wider ones.
USUAL_TOKEN = 16

#: One round. Rows are in the order of `place`, which counts over all words, so neighbours come from windows that need
#: no sort of their own; (rank, place) orders a word's pairs. A part is a number of places of a word, at least twice its
#: longest token; a word of one part contracts its leftmost minimum-rank pair: the left row takes the merged token, the
#: right row goes. In words of more parts those pairs are contracted that have the lowest rank of their own and both
#: neighbouring parts: in runs of overlapping ones every second from the run's left end, or only the leftmost where the
#: merged token is `unsafe`, that is starts merges that rank before it. A word without any pair is marked done.
_CONTRACT = """
with near as (
  select word, part, place, tok, lead(word) over () = word as goes_on, lead(tok) over () as tok_after, lead(place) over () as right_place,
         lag(place) over () as before, lag(word) over () = word and lag(tok) over () = tok as same_before
  from (select word, part, place, tok from grown where not done order by place)),
ranked as (
  select n.word, n.part, n.place, n.tok, n.before, n.right_place, n.same_before and n.tok = n.tok_after as follows, m.merged
  from near n left join merges m on n.goes_on and m.pair = n.tok::bigint * 4294967296 + n.tok_after),
lowest as (select part, min(merged::bigint * 4294967296 + place) as score from ranked group by part),
short_goals as (
  select part, score is null as done, (score // 4294967296)::integer as merged, (score % 4294967296)::integer as at
  from lowest where part not in (select part from long)),
best as (
  select part, least(score, lag(score) over w, lead(score) over w) as score, min(score) over (partition by word) is null as done
  from lowest join long using (part) window w as (partition by word order by part)),
goals as (
  select b.part, b.done, (b.score // 4294967296)::integer as merged, case when u.merged is not null then (b.score % 4294967296)::integer end as alone
  from best b left join unsafe u on u.merged = (b.score // 4294967296)::integer),
long_rows as (select r.*, g.done, coalesce(r.merged = g.merged and coalesce(g.alone, r.place) = r.place, false) as hit from ranked r join goals g using (part)),
runs as (
  select place, right_place, merged, coalesce(follows, false) as follows, row_number() over w as n,
         coalesce(follows, false) and coalesce(lag(right_place) over w = place, false) as goes_on
  from long_rows where hit window w as (order by place)),
starts as (select *, max(case when not goes_on then 2 * n + (not follows)::integer end) over (order by place) as start from runs),
taken as (select place, right_place, merged from starts where start % 2 = 1 and (n - start // 2) % 2 = 0),
changed as (select place, merged from taken union all select right_place, null from taken)
select r.word, r.part, r.place, case when r.place = g.at then g.merged else r.tok end as tok, g.done
from ranked r join short_goals g using (part) where g.at is null or r.before is null or r.before <> g.at
union all
select r.word, r.part, r.place, coalesce(c.merged, r.tok), r.done
from long_rows r left join changed c on c.place = r.place where c.place is null or c.merged is not null
"""


@dataclass(frozen=True)
class Vocabulary:
    """A rank file's tokens, and every way to make a token of two: arrays of left, right and merged token."""

    ranks: dict[bytes, int]
    merges: np.ndarray
    digest: str = ""

    @classmethod
    def read(cls, file: str) -> Vocabulary:
        """Reads base64 tokens and ranks, a line each."""
        with open(file, "rb") as lines:
            raw = lines.read()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        rows = [(ranks[t[:i]], ranks[t[i:]], n) for t, n in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        return cls(ranks, np.array(rows, np.int32).reshape(-1, 3), hashlib.sha256(raw).hexdigest())


class Coder:
    """DuckDB with one vocabulary: words to ids and ids to bytes. It never spills: what it holds is bounded."""

    def __init__(self, vocabulary: Vocabulary):
        self._ranks = ranks = vocabulary.ranks
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": "", "preserve_insertion_order": True})
        left, right, merged = vocabulary.merges.T.astype(np.int64)
        self._make("merges", pa.table({"pair": left << 32 | right, "merged": merged.astype(np.int32)}))
        # bytes as characters of the same number, so that text aggregation can join them
        vocab = pa.table({"tok": pa.array(ranks.values(), pa.int32()), "bytes": pa.array([t.decode("latin-1") for t in ranks], pa.string())})
        self._make("vocab", vocab)
        self._first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._make("unsafe", pa.table({"merged": np.unique(np.concatenate([x[merged < x] for x in (left, right)])).astype(np.int32)}))
        self._long_tokens = sorted((t for t in ranks if len(t) > USUAL_TOKEN), key=len, reverse=True)

    def __enter__(self) -> Coder:
        return self

    def __exit__(self, *_: object) -> None:
        self.con.close()

    def _make(self, name: str, rows: pa.Table) -> None:
        self.con.register("rows_in", rows)
        self.con.execute(f"create or replace table {name} as select * from rows_in")
        self.con.unregister("rows_in")

    def _longest_token(self, word: bytes) -> int:
        """No token in the word has more bytes than this."""
        if len(word) <= 2 * USUAL_TOKEN:
            return USUAL_TOKEN
        return next((len(t) for t in self._long_tokens if t in word), USUAL_TOKEN)

    def words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        some = []
        for i, w in enumerate(words):  # a word that is a token is that token, whatever its merges
            n = self._ranks.get(w)
            if n is not None:
                out[i] = np.array([n], np.uint32)
            elif w:
                some.append(i)
        if not some:
            return out
        sizes = np.array([len(words[i]) for i in some])
        total = int(sizes.sum())
        flat = np.frombuffer(b"".join(words[i] for i in some), np.uint8)
        owner, place = np.repeat(np.arange(len(some), dtype=np.int32), sizes), np.arange(total)
        blocks = np.array([2 * self._longest_token(words[i]) for i in some])
        many = -(-sizes // blocks)
        first = np.cumsum(many) - many
        part = np.repeat(first, sizes) + (place - np.repeat(np.cumsum(sizes) - sizes, sizes)) // np.repeat(blocks, sizes)
        rows = {"word": owner, "place": place.astype(np.int32), "part": part.astype(np.int32), "tok": self._first[flat], "done": np.zeros(total, bool)}
        self._make("state", pa.table(rows))
        of = np.repeat(np.arange(len(some), dtype=np.int32), many)
        long = np.flatnonzero(many[of] > 1).astype(np.int32)
        self._make("long", pa.table({"part": long, "word": of[long]}))
        self.con.execute(f"set memory_limit = '{MEMORY_MB + BYTES_PER_BYTE * total // 1_000_000}MB'")
        got = self.con.execute(
            f"with recursive grown as (select word, part, place, tok, done from state union all ({_CONTRACT})) select word, tok from grown where done order by place"
        ).fetchnumpy()
        bounds = np.searchsorted(np.asarray(got["word"]), np.arange(len(some) + 1))
        ids = np.asarray(got["tok"]).astype(np.uint32)
        for k, i in enumerate(some):
            out[i] = ids[bounds[k] : bounds[k + 1]]
        self.con.execute("drop table state")
        return out

    def texts(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each id sequence (`ids` one after the other, `sizes` of each), by ordered aggregation."""
        rows = pa.table(
            {
                "doc": pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)),
                "place": pa.array(np.arange(len(ids), dtype=np.int32)),
                "tok": pa.array(ids.astype(np.int32)),
            }
        )
        self.con.execute(f"set memory_limit = '{MEMORY_MB + BYTES_PER_BYTE * len(ids) // 1_000_000}MB'")
        self.con.register("ids_in", rows)
        found = self.con.execute(
            # the sorted rows reach the aggregate in order, as one thread reads them and insertion order is preserved
            "select doc, string_agg(bytes, '') as text from (select doc, bytes from ids_in join vocab using (tok) order by place) group by doc"
        ).fetchall()
        self.con.unregister("ids_in")
        out = [b""] * len(sizes)
        for doc, text in found:
            out[doc] = text.encode("latin-1")
        return out


class Remembered:
    """The ids of the words met so far, word after word in one array."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ends = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.steps_met = np.zeros(0, np.int64)

    def forget_rare(self) -> None:
        """Keeps the words that more than one step has met, unless these are too many as well."""
        stay = np.flatnonzero(self.steps_met > 1)
        words = list(self.number)
        ids = [self.ids[self.ends[i] : self.ends[i + 1]] for i in stay]
        self.clear()
        if len(stay) < REMEMBERED // 2:
            self.add([words[i] for i in stay], ids)

    def add(self, words: list[str], ids: list[np.ndarray]) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, *ids])
        self.steps_met = np.concatenate([self.steps_met, np.zeros(len(words), np.int64)])

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, how many each word has)."""
        which = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        met = np.zeros(len(self.steps_met), bool)
        met[which] = True
        self.steps_met += met
        begin, size = self.ends[which], self.ends[which + 1] - self.ends[which]
        last = np.cumsum(size)
        return self.ids[np.arange(size.sum()) + np.repeat(begin - last + size, size)], size


_met: dict[str, Remembered] = {}


def remembered(digest: str) -> Remembered:
    """The words that this worker has met with one vocabulary; those of another go. A cache only: no result depends on it."""
    if digest not in _met:
        _met.clear()
        _met[digest] = Remembered()
    return _met[digest]


def encode_texts(texts: list[str], pattern: regex.Pattern, coder: Coder, known: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, how many each text has); `known` gains the words that are new."""
    pieces = [pattern.findall(t) for t in texts]
    words = list(chain.from_iterable(pieces))
    distinct = set(words)
    new = [w for w in distinct if w not in known.number]
    if len(known.number) + len(new) > REMEMBERED:
        known.forget_rare()
        new = [w for w in distinct if w not in known.number]
    if new:
        known.add(new, coder.words([w.encode("utf-8", "surrogatepass") for w in new]))
    ids, size = known.of(words)
    bounds = np.cumsum([0, *map(len, pieces)])
    ends = np.concatenate([[0], np.cumsum(size)])[bounds]
    return ids, np.diff(ends)


def encoded(docs: DataFrame, vocabulary_file: str, pattern: str, packed: bool = False) -> DataFrame:
    """`docs` (with text) plus ids, n_tokens long and decoded binary: the bytes that the ids decode to.

    ids are an array<int>, or with `packed` a binary of little-endian unsigned 32-bit integers, as training shards have them.

    Every whole text is encoded, null as an empty one: no ids and no bytes. Special tokens are ordinary text. Other
    columns, whatever their names, pass through untouched, repeated rows too; an empty table gives no rows.
    `vocabulary_file` holds base64 tokens and ranks; it is read on the driver and broadcast, as it is of fixed size.
    A step's memory grows with its longest text only.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Vocabulary.read(vocabulary_file))
    added = ("ids", "n_tokens", "decoded")
    docs = docs.drop(*added)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cut = remembered(f"{sent.value.digest} {pattern}"), regex.compile(pattern)
        with Coder(sent.value) as coder:
            for batch in batches:
                for part in steps(batch, most=STEP_BYTES):
                    texts = [t or "" for t in part.column("text").to_pylist()]
                    ids, sizes = encode_texts(texts, cut, coder, known)
                    back = coder.texts(ids, sizes)
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    if packed:
                        raw = ids.astype("<u4").tobytes()
                        column = pa.array([raw[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                    else:
                        column = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))
                    columns = [part.column(name) for name in names]
                    columns += [column, pa.array(sizes.astype(np.int64)), pa.array(back, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return docs.mapInArrow(run, f"{schema}, ids {'binary' if packed else 'array<int>'}, n_tokens long, decoded binary")
