"""Benchmark decontamination against plain enumeration, and on odd inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lociweave.llm import contamination as c

DOCS = "doc_id long, text string, items string, spans string, term string"


def plain_words(text):
    lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, items, width):
    wanted = {}
    for item, text in items:
        w = plain_words(text)
        for s in range(max(1, len(w) - width + 1) if w else 0):
            if item is not None:
                wanted.setdefault(tuple(w[s : s + width]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for x, ids in wanted.items():
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit |= set(range(s, s + len(x)))
                    found |= ids
        out.append((doc_id, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in df.collect()), key=repr)


def corpus(rng, words, n):
    return " ".join(rng.choices(words, k=n))


def test_words_of_every_ascii_character(spark):
    text = "".join(f"A{chr(i)}b " for i in range(128)) + "É ßx Ω1  y"
    assert spark.createDataFrame([(text,)], "t string").select(c.words_of(F.col("t")).alias("w")).first().w == plain_words(text)


@pytest.mark.parametrize("width", [1, 3, 10])
def test_against_enumeration(spark, width):
    """A few words only, so that windows overlap, repeat and share their rarest words."""
    rng = random.Random(width)
    words = ["a", "B", "c", "été", "E2"]
    items = [(i, corpus(rng, words, rng.randint(0, 14))) for i in range(12)]
    docs = [(i, corpus(rng, words, rng.randint(0, 60))) for i in range(30)]
    docs += [(100 + i, f"{corpus(rng, words, 5)}, {text}! {text}") for i, (_, text) in enumerate(items)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(c.contaminated(d, b, width)) == plain(docs, items, width)


def test_proximity_against_enumeration(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    items = [(i, corpus(rng, words, rng.randint(1, 6))) for i in range(8)]
    docs = [(i, corpus(rng, words, rng.randint(0, 40))) for i in range(25)]
    width, within = 3, 6
    want = set()
    for doc_id, text in docs:
        w = plain_words(text)
        for item, other in items:
            x = plain_words(other)
            for s in range(max(1, len(x) - width + 1)):
                if any(set(x[s : s + width]) <= set(w[a : a + within]) for a in range(len(w))):
                    want.add((doc_id, item))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = c.contaminated(d, b, width, within).collect()
    assert {(r.doc_id, i) for r in out for i in r["items"]} == want and want
    for r in out:  # spans hold the words they were found for
        w = plain_words(dict(docs)[r.doc_id])
        assert all(0 <= s.start and s.start + s.length <= len(w) and s.length <= within for s in r.spans)


def test_odd_inputs(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [
        (1, None, "x", "y", "z"), (2, "", None, None, None), (3, " \t.,!", None, None, None), (4, passage, None, None, None), (4, passage, None, None, None),
        (4, "other text", None, None, None), (None, passage.upper(), None, None, None), (0, passage[4:], None, None, None), (5, "word " * 30000 + passage, None, None, None),
    ]
    items = [(1, passage, "a"), (1, passage, "b"), (2, None, "a"), (3, "", "a"), (None, passage, "a"), (4, "word", "a"), (5, "word word", "a"), (6, "zzz " + passage[:30], "a")]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    assert got(c.contaminated(d, b)) == plain([x[:2] for x in docs], [x[:2] for x in items], c.WIDTH)
    assert c.contaminated(d.limit(0), b).count() == 0
    assert {r.n_hit for r in c.contaminated(d, b.limit(0)).collect()} == {0}


def test_terms_in_slices(spark, monkeypatch):
    """Terms beyond one broadcast are looked up slice by slice, with the same result."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, corpus(rng, words, 80)) for i in range(10)]
    items = [(i, docs[i][1][20:90]) for i in range(6)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(c, "MOST_TERM_BYTES", 800)
    assert got(c.contaminated(d, b, 4)) == plain(docs, items, 4)
