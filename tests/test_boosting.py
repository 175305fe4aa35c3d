"""Boosted trees against a plain loop over rows, and on cells whose truth depends on several features."""

import numpy as np
import pytest

from lociweave.operators import boosting as b


def plain(bins, y, classes, rounds, depth, rate, least, ridge):
    """Scores after the same rounds, every split found by trying all cuts of all features on the rows themselves."""
    prior = np.array([(y == k).sum() + 1.0 for k in range(classes)])
    scores = np.tile(np.log(prior / prior.sum()), (len(y), 1))
    for _ in range(rounds):
        p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        step = np.zeros_like(scores)
        for k in range(classes):
            g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])

            def grow(rows, left):
                value = -g[rows].sum() / (h[rows].sum() + ridge)
                best = (1e-9, None)
                if left:
                    whole = g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                    for f in range(bins.shape[1]):
                        for cut in range(bins.max()):
                            low, high = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                            if min(len(low), len(high)) >= least:
                                gain = round(sum(g[r].sum() ** 2 / (h[r].sum() + ridge) for r in (low, high)) - whole, 9)
                                if gain > best[0]:
                                    best = gain, (low, high)
                if best[1] is None:
                    step[rows, k] = value
                else:
                    grow(best[1][0], left - 1)
                    grow(best[1][1], left - 1)

            grow(np.arange(len(y)), depth)
        scores = scores + rate * step
    return scores


def test_against_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (300, 3)).astype(float)
    y = ((x[:, 0] > 2).astype(int) + (x[:, 1] > 3) * (rng.random(300) < 0.8)).astype(int)
    rows = spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "sample_id long, a double, b double, c double, y int").repartition(5)
    model = b.fitted(rows, ("a", "b", "c"), "y", rounds=3, depth=2, least_rows=10)
    bins = model.bins(x)
    want = plain(bins.astype(int), y, 3, 3, 2, 0.3, 10, 1.0)
    assert np.abs(model.scores(bins) - want).max() < 1e-9
    got = {r.sample_id: r.gp for r in b.predicted(rows, model, ("sample_id",)).collect()}
    p = np.exp(want) / np.exp(want).sum(1, keepdims=True)
    assert np.abs(np.array([got[i] for i in range(300)]) - p).max() < 1e-5


def test_missing_values_single_classes_and_no_rows(spark):
    schema = "sample_id long, a double, y int"
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else float(i), int(i % 3 == 0)) for i in range(90)] + [(99, 1.0, -1)], schema)
    model = b.fitted(rows, ("a",), "y", classes=2, rounds=8, least_rows=5)
    out = {r.sample_id: r.gp for r in b.predicted(rows, model, ("sample_id",)).collect()}
    assert len(out) == 91 and np.mean([out[i][int(i % 3 == 0)] > 0.5 for i in range(90)]) > 0.95
    one = b.fitted(rows.where("y = 1"), ("a",), "y", classes=2, rounds=1)
    assert all(r.gp[1] > 0.9 for r in b.predicted(rows, one, ("sample_id",)).collect())
    none = b.fitted(rows.limit(0), ("a",), "y", classes=2, rounds=1)
    assert {tuple(r.gp) for r in b.predicted(rows, none, ("sample_id",)).collect()} == {(0.5, 0.5)}


def test_boosted_calls_of_held_out_samples(spark):
    """Truth of samples that taught nothing, by calls and by likelihood."""
    from lociweave.plans.boosting_queries import q_boosted_calls

    out = [r for r in q_boosted_calls(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.truth >= 0]
    assert len(out) > 50
    right = np.mean([np.argmax([r.p0, r.p1, r.p2]) == r.truth for r in out])
    assert right > 0.95
    assert np.mean([-np.log((r.p0, r.p1, r.p2)[r.truth]) for r in out]) < 0.25
    assert all(r.p0 + r.p1 + r.p2 == pytest.approx(1, abs=1e-5) for r in out)


def test_cells_are_worked_out_once(spark, monkeypatch):
    from lociweave.plans import boosting_queries, domain

    seen = []
    monkeypatch.setattr(domain, "reads", lambda *a, reads=domain.reads: seen.append(a) or reads(*a))
    out = boosting_queries.q_boosted_calls(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and "lineitem" not in str(out.inputFiles())
