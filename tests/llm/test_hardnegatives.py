"""Hard negatives against plain enumeration; bounds and walks by themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.llm import hardnegatives as h

SCHEMA = "id long, label int, vector array<long>, block string, cluster string, low string"


def plain(rows, anchors, positives=5, negatives=3):
    seen = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None:
            seen[i] = min(seen.get(i, (v, label)), (v, label))
    out = []
    for a in anchors:
        if a not in seen:
            continue
        va, la = seen[a]
        scored = sorted((-int(np.dot(va, v)), i, label) for i, (v, label) in seen.items() if i != a and len(v) == len(va))
        for sp, p, _ in [x for x in scored if x[2] == la][:positives]:
            fits = [(s, i) for s, i, label in scored if label != la and 50 * -sp <= 100 * -s <= 95 * -sp]
            out += [(a, p, rank, i, -sp, -s) for rank, (s, i) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for spread in (0.05, 0.5, 3):
        members = rng.normal(size=(20, 6)) * spread + 1
        members[3] = 0
        rows = np.r_[rng.normal(size=(200, 6)), members * 2, -members]
        units = np.delete(members, 3, 0)  # the zero vector scores 0 with all, which is its length times any bound
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        assert ((rows @ units.T).max(1) <= h.upper_bounds(rows, members) + 1e-9).all()


def test_walk_ends_early_in_clustered_data():
    """Where clusters are tight, a walk is certified long before the end of its list."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32)) * 100
    rows = np.round(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 5).astype(np.int64)
    members = rows[np.argsort(((rows - rows[0]) ** 2).sum(1))[:20]]
    bound = h.upper_bounds(rows.astype(float), members.astype(float))
    order = np.argsort(-bound, kind="stable")
    low, high = np.full((20, 1), -np.inf), np.full((20, 1), np.inf)
    best, scored = h.walk(rows[order], np.arange(4000)[order], bound[order], members, np.full(20, -1), low, high, 5)
    assert scored < 0.2 * 20 * 4000
    want = np.sort(members @ rows.T, 1)[:, -5:]
    assert (np.sort(best[:, 0] // 2**31, 1) == want).all()


@pytest.mark.parametrize("shard_rows,block,members", [(4096, 4096, 64), (16, 3, 2)])
def test_against_enumeration(spark, monkeypatch, shard_rows, block, members):
    monkeypatch.setattr(h, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(h, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(h, "MEMBERS", members)
    monkeypatch.setattr(h, "SPREAD", 2)
    monkeypatch.setattr(h, "FIRST_STEP", 4)
    rng = np.random.default_rng(4)
    vectors = rng.integers(-3, 4, (150, 5))
    vectors[40:90] = vectors[40]  # a third of all rows are one vector
    rows = [(int(i), int(rng.integers(0, 3)), [int(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    walked = []
    out = got(h.hard_negatives(df, F.col("id") % 5 == 0, walked=walked))
    assert out == plain(rows, range(0, 150, 5)) and out
    assert 0 < sum(x[0] for x in walked) <= sum(x[1] for x in walked)


def test_odd_inputs(spark):
    rows = [
        (0, 1, [1, 2]), (1, 1, [2, 1]), (2, 2, [1, 1]), (2, 3, [1, 1]), (3, None, [5, 5]), (None, 1, [5, 5]), (4, 2, None), (5, 1, [0, 0]), (6, 2, [0, 0]),
        (10, 1, [1, 2, 3]), (11, 2, [1, 2, 2]), (12, 1, [1, 2, 4]), (15, 7, []), (16, 7, []), (17, 8, []), (20, 2, [-5, -5]), (25, 9, [3, 3]), (-5, 1, [2, 2]),
    ]
    df = spark.createDataFrame([(*r, "b", "c", "l") for r in rows], SCHEMA)
    assert got(h.hard_negatives(df, F.col("id") % 5 == 0)) == plain(rows, [0, 5, 10, 15, 20, 25, -5])
    assert got(h.hard_negatives(df.limit(0), F.col("id") % 5 == 0)) == []
    assert got(h.hard_negatives(df, F.col("id") == 77)) == []
