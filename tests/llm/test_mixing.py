"""Raking on tables whose targets cannot all be met, against a plain loop; it never fails and never ends worse than it began."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lociweave.llm import mixing

SCHEMA = "source string, lang string, topic string, tokens long"


def cells_of(shape, seed, share=1.0):
    rng = random.Random(seed)
    names = [[f"{m}{i}" for i in range(n)] for m, n in zip("slt", shape, strict=True)]
    out = [(*k, int(10 ** rng.uniform(1, 5))) for k in itertools.product(*names) if rng.random() < share]
    return out or [("s0", "l0", "t0", 5)]


def plain(cells, aims, keep):
    """(probabilities, residual) by the same rounds, one cell at a time."""
    total = sum(c[3] for c in cells)
    p, best, lowest = [keep] * len(cells), None, []

    def expected(m, v):
        return sum(x * c[3] for x, c in zip(p, cells, strict=True) if c[m] == v)

    def miss():
        return round(sum(abs(aims[m][v] - expected(m, v)) for m in range(3) for v in aims[m]) / total, 9)

    first = miss()
    while True:
        for m in range(3):
            now = {v: expected(m, v) for v in aims[m]}
            p = [min(1.0, x * aims[m][c[m]] / now[c[m]]) if now[c[m]] > 0 else x for x, c in zip(p, cells, strict=True)]
        r = miss()
        if not lowest or r < lowest[-1]:
            best = list(p), r
        lowest.append(min([r, *lowest[-1:]]))
        if lowest[-1] <= mixing.TOLERANCE or len(lowest) > mixing.PATIENCE and lowest[-1] > lowest[-1 - mixing.PATIENCE] - mixing.GAIN:
            return *best, first


def check(spark, cells, keep, powers=mixing.POWERS):
    total, aims = sum(c[3] for c in cells), []
    for m, name in enumerate(mixing.MARGINS):
        own = {}
        for c in cells:
            own[c[m]] = own.get(c[m], 0) + c[3]
        weight = {v: n ** powers[name] for v, n in own.items()}
        aims.append({v: keep * total * w / sum(weight.values()) for v, w in weight.items()})
    want, residual, first = plain(cells, aims, keep)
    out = mixing.raked(spark.createDataFrame(cells, SCHEMA), powers, keep)
    got = {(r.source, r.lang, r.topic): r.p for r in out.collect()}
    assert len(got) == len(cells) and all(0 <= p <= 1 for p in got.values())
    assert [got[c[:3]] for c in cells] == pytest.approx(want, abs=1e-7)
    left = mixing.residuals(out, powers, keep).agg(F.sum(F.abs(F.col("target") - F.col("expected")))).first()[0] / total
    assert left == pytest.approx(residual, abs=1e-7) and left <= first + 1e-9
    return left


@pytest.mark.parametrize("seed", range(3))
def test_two_by_two_by_two(spark, seed):
    check(spark, cells_of((2, 2, 2), seed), 0.9, {"source": 0.0, "lang": 0.0, "topic": 1.0})


@pytest.mark.parametrize("share", [0.9, 0.5, 0.3])
def test_absent_cells(spark, share):
    check(spark, cells_of((6, 4, 5), int(share * 10), share), 0.6)


def test_a_source_in_one_language_only(spark):
    """No language of its own can be raised without its source: the margins contradict each other, and the result is still the nearest."""
    cells = [("web", "en", "a", 90_000), ("web", "en", "b", 5_000), ("books", "de", "a", 900), ("news", "fr", "b", 50)]
    assert check(spark, cells, 0.95, {"source": 0.0, "lang": 0.0, "topic": 0.0}) > 0.01


def test_targets_that_can_be_met_are(spark):
    assert check(spark, cells_of((4, 3, 3), 11), 0.3, {"source": 0.9, "lang": 0.9, "topic": 1.0}) <= 1e-5


def test_cells_as_rows_give_the_same(spark, monkeypatch):
    """Beyond CELLS_TOGETHER cells are not one row; six rounds of either are alike."""
    monkeypatch.setattr(mixing, "MOST_ROUNDS", 6)
    cells = cells_of((5, 3, 4), 4, 0.8)
    frame = spark.createDataFrame(cells, SCHEMA)
    one = {r[:3]: r.p for r in mixing.raked(frame).collect()}
    monkeypatch.setattr(mixing, "CELLS_TOGETHER", 0)
    assert {r[:3]: r.p for r in mixing.raked(frame).collect()} == pytest.approx(one, abs=1e-9)


def test_cells_without_tokens_and_no_cells(spark):
    cells = [("a", "x", "p", 0), ("b", "y", "q", 0)]
    assert {r.p for r in mixing.raked(spark.createDataFrame(cells, SCHEMA)).collect()} == {mixing.KEEP_SHARE}
    assert mixing.raked(spark.createDataFrame([], SCHEMA)).count() == 0
    mixed = [("a", "x", "p", 0), ("b", "y", "q", 100), ("b", "x", "q", 50)]
    assert mixing.raked(spark.createDataFrame(mixed, SCHEMA)).count() == 3


def test_very_long_and_odd_documents(spark):
    long = "word " * 400_000
    rows = [(1, long, "en", "a", 1.0), (2, None, None, None, 1.0), (3, "", "en", "a", 1.0), (3, "x y", "de", "b", 1.0), (None, "z", "fr", "a", 1.0)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, p double")).collect()
    assert len(out) == 5 and {r.n_tokens for r in out if r.doc_id == 1} == {400_000} and all(0 <= r.probability <= 1 for r in out)
