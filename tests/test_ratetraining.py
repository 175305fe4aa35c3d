"""Trained recombination rates against a loop in numpy, and a planted hotspot."""

import numpy as np

from lociweave.operators import hmm, ratetraining
from lociweave.operators.sites import recombination
from lociweave.plans import rate_queries

SITES = "chrom string, pos long, cm double, note string"
SAMPLES = "sample_id long, generation double"


def looped(pos, rates, hap, generations, overall, window):
    """The same of one chromosome, interval by interval."""
    switch = np.median(np.clip(1 - (hap[:, 1:] * hap[:, :-1]).sum(2), 1e-6, 1 - 1e-6), 0)
    ages = [g for g in generations if g is not None and np.isfinite(g) and g > 0]
    ratio = -np.log1p(-switch) / (np.median(ages) if ages else 1) / rates[1:]
    scale = float(np.clip(np.median(ratio), 0.25, 4))
    out = rates.copy()
    if overall:
        out[1:] *= scale
    if window:
        where = (pos[1:] - pos[0]) // window
        for w in set(where):
            mine = where == w
            if mine.sum() >= 2:
                local = np.clip(np.median(ratio[mine]), 0.25, 4)
                out[1:][mine] *= np.clip(1 + mine.sum() / (mine.sum() + 20) * (local / (scale if overall else 1) - 1), 0.25, 4)
    out = np.clip(out, 1e-10, 0.25)
    out[0] = 1e-10
    return out


def made(spark, seed=3):
    rng = np.random.default_rng(seed)
    pos = np.sort(rng.choice(9000, 80, replace=False)) + 1
    cm = np.cumsum(rng.uniform(0.01, 0.5, 80))
    hap = rng.dirichlet(np.full(4, 0.3), (6, 80))
    hap[:, 40:] = np.repeat(hap[:, 40:41], 40, 1)
    rows = [(int(s), "a", int(p), hap[s, i].tolist()) for s in range(6) for i, p in enumerate(pos)]
    haps = spark.createDataFrame(rows + [(0, "b", 5, [1.0, 0.0, 0.0, 0.0])], "sample_id long, chrom string, pos long, hap array<double>")
    sites = spark.createDataFrame([("a", int(p), float(c), "x") for p, c in zip(pos, cm)] + [("b", 5, 0.0, "x"), ("c", 1, 0.0, None), ("c", 2, 1.0, None)], SITES)
    ages = [10.0, 20.0, None, float("nan"), 0.0, 30.0]
    rates = np.r_[1e-10, np.clip(np.diff(cm) / 100, 1e-10, 0.25)]
    return pos, rates, hap, ages, haps, sites, spark.createDataFrame(list(enumerate(ages)), SAMPLES)


def test_rates_against_a_loop(spark):
    pos, rates, hap, ages, haps, sites, samples = made(spark)
    for overall, window in ((True, 0), (True, 700), (False, 700)):
        got = {(r.chrom, r.pos): r.rate for r in ratetraining.trained_rates(haps, sites, samples, overall, window).collect()}
        assert np.allclose([got["a", int(p)] for p in pos], looped(pos, rates, hap, ages, overall, window), rtol=1e-9)
        assert got["b", 5] == got["c", 1] == 1e-10 and abs(got["c", 2] - 0.01) < 1e-12


def test_map_gives_the_rates_back(spark):
    *_, haps, sites, samples = made(spark)
    rates = ratetraining.trained_rates(haps, sites, samples, True, 700)
    again = {(r.chrom, r.pos): r.rate for r in recombination(ratetraining.remapped(sites, rates)).collect()}
    assert all(abs(again[r.chrom, r.pos] - r.rate) < 1e-12 for r in rates.collect())
    assert {r.chrom for r in ratetraining.summary(rates).collect()} == {"a", "b", "c"}
    assert ratetraining.trained_rates(haps.limit(0), sites, samples).where("abs(rate - rate_before) > 1e-15").count() == 0
    assert ratetraining.trained_rates(haps, sites.limit(0), samples).count() == 0


def test_planted_hotspot_is_found(spark):
    """Samples that change founders at every site of one window: its rate grows against the others."""
    rng = np.random.default_rng(5)
    n, k = 60, 3
    q = rng.integers(0, 2, (n, k)) * 0.96 + 0.02
    sites = spark.createDataFrame([("a", i * 100, i * 0.02, "x") for i in range(n)], SITES)
    panel = spark.createDataFrame([(i * 100, f, float(q[i, f])) for i in range(n) for f in range(k)], "pos long, founder long, alt_prob double")
    cells = []
    for s in range(12):
        path = (s + np.clip(np.arange(n) - 24, 0, 5)) % k
        for i in range(n):
            alt = q[i, path[i]] > 0.5
            cells.append((s, i * 100, 0.0 if alt else 6.0, 6.0 if alt else 0.0, 0.0))
    evidence = spark.createDataFrame(cells, "sample_id long, pos long, ref_weight double, alt_weight double, other_weight double")
    samples = spark.createDataFrame([(s, 10.0) for s in range(12)], SAMPLES)
    out = ratetraining.trained_positions(evidence, sites, samples, panel, 1, rounds=2, overall=False, window=500)
    rates = {r.pos // 500: r.rate for r in recombination(out).where("pos % 500 = 200").collect()}
    hot = max(rates, key=rates.get)
    assert hot == 5 and rates[hot] > 1.2 * np.median(list(rates.values()))
    assert ratetraining.trained_positions(evidence, sites, samples, panel, overall=False) is sites
    assert hmm.posteriors(evidence, out, samples, panel, 1).count() == 12 * n


def test_queries_have_the_switches_they_need(spark, folder):
    """Both asked posteriors for no column and then for hap: F2, F3."""
    assert "rate" in rate_queries.q_recombination_training(spark, folder).columns
    assert "scale" in rate_queries.q_recombination_training_summary(spark, folder).columns
