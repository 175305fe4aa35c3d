"""HMM jobs against a plain dense version: explicit transition matrices, one sample, one site, one state at a time."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.operators import evidence as ev
from lociweave.operators import founders, hmm, sites

ERROR, FLOOR = hmm.ERROR, hmm.FLOOR


def case(spark, rng, n_sites=23, n_samples=5, k=3, depth=0.4, chroms=("a", "b"), step=2000):
    """Tables of a small random case: evidence, positions, samples, panel, observations."""
    positions = [(chroms[i * len(chroms) // n_sites], 1000 + step * i, step * i * 1e-4) for i in range(n_sites)]
    samples = [(s, 20.0 + 7 * s) for s in range(n_samples)]
    panel = [(p, f, float(rng.random())) for _, p, _ in positions for f in range(k)]
    seen, name = [], 0
    for s, _ in samples:
        for i in range(n_sites):
            if rng.random() < depth:
                for j in range(i, min(n_sites, i + int(rng.integers(1, 4)))):
                    seen.append((s, name, positions[j][1], int(rng.integers(0, 3)), int(rng.integers(5, 40)), name * 1.0))
                name += 1
    counts = {}
    for s, _, p, code, qual, _ in seen:
        w = 1 - 10 ** (-qual / 10)
        c = counts.setdefault((s, p), [0, 0, 0, 0.0, 0.0, 0.0])
        c[code] += 1
        c[3 + code] += w
    columns = "sample_id long, pos long, ref_count long, alt_count long, other_count long, ref_weight double, alt_weight double, other_weight double"
    return {
        "positions": positions, "samples": samples, "panel": panel, "seen": seen, "counts": counts, "k": k,
        "evidence_df": spark.createDataFrame([(*key, *v) for key, v in counts.items()] or [], columns),
        "positions_df": spark.createDataFrame(positions, "chrom string, pos long, cm double"),
        "samples_df": spark.createDataFrame(samples, "sample_id long, generation double"),
        "panel_df": spark.createDataFrame(panel, "pos long, founder long, alt_prob double"),
        "seen_df": spark.createDataFrame(seen, "sample_id long, fragment long, pos long, code int, qual int, ord double"),
    }


def of(given):
    return given["evidence_df"], given["positions_df"], given["samples_df"], given["panel_df"]


def clip(x, low=FLOOR, high=1.0):
    return min(high, max(low, x))


def dense(given, ploidy, shape=None, panel=None, mode=None):
    """{(sample, pos): (hap, gp)} over ordered founder tuples, whole chromosomes."""
    k = given["k"]
    q = {(p, f): v for p, f, v in (panel or given["panel"])}
    states = list(product(range(k), repeat=ploidy))
    whole = {}
    if mode:
        by_name = {}
        for s, name, p, code, qual, _ in sorted(given["seen"], key=lambda x: (x[0], x[1], x[2], -x[4], x[5], x[3])):
            by_name.setdefault((s, name), {}).setdefault(p, (code, qual))
        for (s, _), obs in by_name.items():
            log = []
            for f in range(k):
                total = 0.0
                for p, (code, qual) in obs.items():
                    e, a = 10 ** (-qual / 10), q[p, f]
                    total += np.log(clip([(1 - a) * (1 - e) + a * e / 3, a * (1 - e) + (1 - a) * e / 3, e / 3][code]))
                log.append(total)
            prob = [np.exp(max(x - max(log), -np.log(1000.0))) for x in log]
            mean = sum(obs) / len(obs)
            centre = min(obs, key=lambda p: (abs(p - mean), p))
            whole.setdefault((s, centre), []).append(prob)
    out = {}
    for chrom in {c for c, _, _ in given["positions"]}:
        here = sorted((p, cm) for c, p, cm in given["positions"] if c == chrom)
        for s, generation in given["samples"]:
            emission, moves = [], []
            for t, (p, cm) in enumerate(here):
                ref, alt, other = given["counts"].get((s, p), [0] * 6)[3:]
                log = []
                for state in states:
                    a = np.mean([q[p, f] for f in state])
                    log.append(alt * np.log(clip(a * (1 - ERROR) + (1 - a) * ERROR / 3)) + ref * np.log(clip((1 - a) * (1 - ERROR) + a * ERROR / 3)) + other * np.log(clip(ERROR / 3)))
                log = np.array(log)
                if (s, p) in whole:
                    pieces = sum(np.log([clip(np.mean([x[f] for f in state])) for state in states]) for x in whole[s, p])
                    log = pieces + (log if mode == "augment" else 0)
                    log = np.maximum(log - log.max(), -np.log(1e10))
                emission.append(np.exp(log - log.max()))
                rate = 1e-10 if t == 0 else min(0.25, max(1e-10, (cm - here[t - 1][1]) / 100))
                sw = min(1 - 1e-10, max(1e-10, 1 - np.exp(-generation * rate)))
                one = np.where(np.eye(k) == 1, 1 - sw, sw / max(k - 1, 1)) if shape is None else (1 - sw) * np.eye(k) + sw * shape
                m = np.ones((1, 1))
                for _ in range(ploidy):
                    m = np.kron(m, one)
                moves.append(m)
            forward, backward = [emission[0] / emission[0].sum()], [np.ones(len(states))]
            for t in range(1, len(here)):
                x = forward[-1] @ moves[t] * emission[t]
                forward.append(x / x.sum())
            for t in range(len(here) - 1, 0, -1):
                x = moves[t] @ (backward[0] * emission[t])
                backward.insert(0, x / x.sum())
            for t, (p, _) in enumerate(here):
                gamma = forward[t] * backward[t]
                gamma = gamma / gamma.sum()
                hap, gp = np.zeros(k), np.zeros(ploidy + 1)
                for g, state in zip(gamma, states, strict=True):
                    dist = np.ones(1)
                    for f in state:
                        hap[f] += g / ploidy
                        dist = np.convolve(dist, [1 - q[p, f], q[p, f]])
                    gp += g * dist
                out[s, p] = hap, gp
    return out


def check(df, want, digits=1e-8):
    rows = df.collect()
    assert len(rows) == len(want)
    for r in rows:
        hap, gp = want[r.sample_id, r.pos]
        assert np.abs(np.array(r.hap) - hap).max() < digits and np.abs(np.array(r.gp) - gp).max() < digits
        assert abs(r.dosage - gp @ np.arange(len(gp))) < digits


@pytest.mark.parametrize("ploidy", [1, 2, 3])
def test_posteriors(spark, ploidy):
    given = case(spark, np.random.default_rng(ploidy))
    check(hmm.posteriors(*of(given), ploidy), dense(given, ploidy))


@pytest.mark.parametrize("ploidy,mode", [(1, "replace"), (2, "replace"), (2, "augment"), (3, "augment")])
def test_fragments(spark, ploidy, mode):
    given = case(spark, np.random.default_rng(10 + ploidy))
    best = ev.compressed(given["seen_df"])
    check(hmm.posteriors(*of(given), ploidy, fragments=best, mode=mode), dense(given, ploidy, mode=mode))


def test_factorised_moves(spark):
    given = case(spark, np.random.default_rng(20))
    shape = np.random.default_rng(1).random((3, 3))
    shape /= shape.sum(1, keepdims=True)
    check(hmm.posteriors(*of(given), 2, shape=shape), dense(given, 2, shape))


@pytest.mark.parametrize("ploidy,shaped", [(1, False), (2, False), (2, True), (3, False)])
def test_blocks_give_what_whole_chromosomes_give(spark, ploidy, shaped):
    """Hardly any reads on close sites, so that what lies blocks away still counts."""
    given = case(spark, np.random.default_rng(30 + ploidy), n_sites=40, depth=0.04, chroms=("a",), step=100)
    shape = None
    if shaped:
        shape = np.random.default_rng(2).random((3, 3))
        shape /= shape.sum(1, keepdims=True)
    check(hmm.posteriors(*of(given), ploidy, core=7, shape=shape), dense(given, ploidy, shape))


def test_blocks_at_low_depth_against_one_block(spark):
    given = case(spark, np.random.default_rng(40), n_sites=700, n_samples=3, depth=0.02, chroms=("a",), step=300)
    one, many = hmm.posteriors(*of(given), 2), hmm.posteriors(*of(given), 2, core=64)
    both = one.join(many.select("sample_id", "pos", F.col("dosage").alias("other")), ["sample_id", "pos"])
    assert both.count() == 2100 and both.agg(F.max(F.abs(F.col("dosage") - F.col("other")))).first()[0] < 1e-9


def test_pair_posteriors_across_borders(spark):
    given = case(spark, np.random.default_rng(50), n_sites=30, depth=0.1, step=300)
    one, many = hmm.haploid_pair_posteriors(*of(given)), hmm.haploid_pair_posteriors(*of(given), core=4)
    a, b = ({(r.chrom, r.pos, r.i, r.j): r.n for r in df.collect()} for df in (one, many))
    assert a.keys() == b.keys() and len(a) == 28 * 9 and max(abs(a[x] - b[x]) for x in a) < 1e-9


def test_runs_in_one_job(spark):
    """Two panels and two sets of reads scanned together equal scans of their own."""
    rng = np.random.default_rng(60)
    given = case(spark, rng)
    other = [(p, f, float(rng.random())) for p, f, _ in given["panel"]]
    panels = spark.createDataFrame([(0, *x) for x in given["panel"]] + [(1, *x) for x in other], "run int, pos long, founder long, alt_prob double")
    e, pos, s, _ = of(given)
    out = hmm.posteriors(e, pos, s, panels, 2, core=9, fragments=ev.compressed(given["seen_df"]))
    for run, panel in ((0, None), (1, other)):
        check(out.where(F.col("run") == run), dense(given, 2, panel=panel, mode="replace"))
    none = e.where("pos > 1010").withColumn("run", F.lit(1)).unionByName(e.withColumn("run", F.lit(0)))
    out = hmm.posteriors(none, pos, s, given["panel_df"], 1)
    check(out.where("run = 0"), dense(given, 1))
    check(out.where("run = 1"), dense(given | {"counts": {k: v for k, v in given["counts"].items() if k[1] > 1010}}, 1))


def learned(given, panel, rounds, ploidy, damping=0.5):
    """Dense EM: (panel, largest changes)."""
    panel, deltas = dict(panel), []
    for _ in range(rounds):
        post = dense(given, ploidy, panel=[(p, f, v) for (p, f), (v, _) in panel.items()])
        new = {}
        for (p, f), (v, immutable) in panel.items():
            cells = [(post[s, p][0][f], (c[4] + 0.5) / (c[3] + c[4] + 1)) for (s, at), c in given["counts"].items() if at == p]
            low = sum(h for h, _ in cells)
            value = sum(h * x for h, x in cells) / low if low > 1e-8 else v
            new[p, f] = (v if immutable else min(1 - 1e-4, max(1e-4, damping * v + (1 - damping) * value)), immutable)
        deltas.append(max(abs(new[x][0] - panel[x][0]) for x in new if not new[x][1]))
        panel = new
    return panel, deltas


def test_em_against_dense(spark):
    given = case(spark, np.random.default_rng(70), depth=0.8)
    start = {(p, f): (v, int(f == 0)) for p, f, v in given["panel"]}
    df = spark.createDataFrame([(p, f, v, i) for (p, f), (v, i) in start.items()], "pos long, founder long, alt_prob double, immutable int")
    out, deltas = founders.learn_founders(*of(given)[:3], df, rounds=3)
    want, changes = learned(given, start, 3, 2)
    assert deltas == pytest.approx(changes, abs=1e-8)
    assert {(r.pos, r.founder): r.alt_prob for r in out.collect()} == pytest.approx({x: v for x, (v, _) in want.items()}, abs=1e-8)


def test_em_patience_and_restoring(spark):
    given = case(spark, np.random.default_rng(71), n_sites=8)
    df = given["panel_df"].withColumn("immutable", F.lit(0))
    _, deltas = founders.learn_founders(*of(given)[:3], df, rounds=6, tolerance=1.0, patience=2, least_rounds=3)
    assert len(deltas) == 4  # calm from round 3 on, and two in a row
    out, deltas = founders.learn_founders(*of(given)[:3], df, rounds=3, tolerance=1.0, patience=3)
    best = int(np.argmin(deltas)) + 1
    want, _ = founders.learn_founders(*of(given)[:3], df, rounds=best, tolerance=0.0)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in want.collect()}


def test_multistart_against_dense(spark):
    given = case(spark, np.random.default_rng(72), n_sites=10, depth=1.0)
    panel = sites.padded(given["panel_df"].where("founder = 0"), 3)
    out, scores = founders.multistart(*of(given)[:3], panel, starts=3, seed=5, rounds=2)
    fractions = ev.site_alt_fraction(given["evidence_df"])
    totals = []
    for k in range(3):
        first = founders.initial_founders(panel, fractions, 5 + k, 0.02 if k else 0.0)
        start = {(r.pos, r.founder): (r.alt_prob, r.immutable) for r in first.collect()}
        assert all(v in (0.02, 0.98) for v, i in start.values() if not i) == (k == 0)
        want, _ = learned(given, start, 2, 2)
        post, total = dense(given, 2, panel=[(p, f, v) for (p, f), (v, _) in want.items()]), 0.0
        for (s, p), c in given["counts"].items():
            alt = min(1 - 1e-6, max(1e-6, post[s, p][1] @ [0, 0.5, 1]))
            total += c[0] * np.log((1 - alt) * 0.99 + alt * 0.01 / 3) + c[1] * np.log(alt * 0.99 + (1 - alt) * 0.01 / 3) + c[2] * np.log(0.01 / 3)
        totals.append((total, want))
    rows = sorted(scores.collect())
    assert [r.read_log_likelihood for r in rows] == pytest.approx([t for t, _ in totals], abs=1e-6)
    best = int(np.argmax([t for t, _ in totals]))
    assert [r.selected for r in rows] == [k == best for k in range(3)]
    assert {(r.pos, r.founder): r.alt_prob for r in out.collect()} == pytest.approx({x: v for x, (v, _) in totals[best][1].items()}, abs=1e-8)
    fixed, scores = founders.multistart(*of(given)[:3], given["panel_df"].withColumn("immutable", F.lit(1)), starts=3, rounds=2)
    assert scores.count() == 1 and {(r.pos, r.founder, r.alt_prob) for r in fixed.collect()} == set(given["panel"])
