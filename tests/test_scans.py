"""Sums made where a block is scanned equal sums over the cells that leave it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.operators import crossvalidation, founders, hmm, ratetraining


@pytest.fixture(scope="module")
def given_(spark):
    rng = np.random.default_rng(11)
    sites = [("c" if p < 30 else "d", p, "A", "C", p * 0.5) for p in range(40)]
    reads = []
    for s in range(4):
        for p in range(40):
            if rng.random() < 0.7:
                n = [int(x) for x in rng.integers(0, 4, 3)]
                reads.append((s, p, *n, *[0.9 * x for x in n]))
    panel = [(r, p, f, float(rng.uniform(0.05, 0.95)), int(f == 0)) for r in range(2) for p in range(40) for f in range(3)]
    return (
        spark.createDataFrame(reads, "sample_id long, pos long, ref_count int, alt_count int, other_count int, ref_weight double, alt_weight double, other_weight double"),
        spark.createDataFrame(sites, "chrom string, pos long, ref string, alt string, cm double"),
        spark.createDataFrame([(s, 10.0 + s) for s in range(4)], "sample_id long, generation double"),
        spark.createDataFrame(panel, "run int, pos long, founder long, alt_prob double, immutable int"),
    )


def close(got, want, keys, values):
    a, b = ({tuple(r[k] for k in keys): [r[v] for v in values] for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a)
    for k in a:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("core", [20, 4096])
def test_sums_in_blocks_equal_sums_over_cells(given_, core):
    evidence, positions, samples, panel = given_
    cells = hmm.posteriors(evidence, positions, samples, panel, 2, core=core).cache()
    close(hmm.scanned_founder_statistics(evidence, positions, samples, panel, core=core), hmm.m_step(cells.select("run", "sample_id", "pos", "hap"), hmm.alt_fractions(evidence)), ["run", "pos", "founder"], ["numerator", "denominator"])
    close(hmm.scanned_read_log_likelihoods(evidence, positions, samples, panel, core=core), founders.read_log_likelihoods(cells, evidence), ["run", "sample_id"], ["read_log_likelihood"])
    one = panel.where("run = 1").drop("run")
    cells = hmm.posteriors(evidence, positions, samples, one, 1, core=core)
    close(hmm.scanned_pair_counts(evidence, positions, samples, one, 1, core=core), hmm.pair_counts(cells), ["i", "j"], ["n"])
    close(hmm.scanned_switches(evidence, positions, samples, one, 1, core=core), ratetraining.interval_switches(cells), ["chrom", "pos"], ["switch"])


def test_runs_share_one_layout_of_reads(given_):
    evidence, positions, samples, panel = given_
    grid = hmm.laid_out(evidence, positions, samples, panel, core=20)
    assert grid.left.where("kind = 1").count() == evidence.count()
    again = hmm.posteriors(evidence, positions, samples, panel.where("run = 1"), core=20, grid=grid._replace(runs=[1]), wanted=("dosage",))
    assert again.columns == ["run", "sample_id", "chrom", "pos", "dosage"]
    close(again, hmm.posteriors(evidence, positions, samples, panel, core=20).where("run = 1"), ["run", "sample_id", "pos"], ["dosage"])
    assert again.select("run").distinct().collect() == [(1,)]
    assert again.where(F.col("dosage").isNull()).isEmpty()


def test_a_run_without_some_sites_is_scanned_as_alone(given_):
    evidence, positions, samples, panel = given_
    some = panel.where("run = 0 or pos % 4 != 1")
    together = hmm.posteriors(evidence, positions, samples, some, core=20).where("run = 1")
    close(together, hmm.posteriors(evidence, positions, samples, some.where("run = 1"), core=20), ["sample_id", "pos"], ["dosage"])


def test_rounds_of_messages_shuffle_no_reads(given_):
    """Every round shuffled all reads and sites: F21, F14, F24."""
    evidence, positions, samples, panel = given_
    grid = hmm.laid_out(evidence, positions, samples, panel, core=10)
    dealt = hmm._sides(grid, samples, panel, None)
    assert dealt.left.count() == 4 * samples.count() and dealt.right is None
    scan = dealt.mapped(lambda left, right: left.select(["sample_id", "pos"]).slice(0, len(left) if len(right) == 20 else 0), "sample_id long, pos long")
    assert scan.where("pos is not null").count() == evidence.count()
    assert scan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # of samples and messages


def above_scan(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan[: plan.index("FlatMap")]


def test_what_scans_make_is_not_broadcast(given_):
    """Spark took the rows of a scan for as few bytes as its samples and sent all of them to the driver: F1 q_cv_harness, F6 q_em_founders."""
    evidence, positions, samples, panel = given_
    folds = positions.select("pos", (F.col("pos") % 2).cast("int").alias("fold"))
    held = crossvalidation.held_out_predictions(evidence, positions, samples, panel.where("run = 0").drop("run"), folds, 2)
    assert "Join" not in above_scan(held) and held.where("pos % 2 <> fold").isEmpty()
    statistics = hmm.scanned_founder_statistics(evidence, positions, samples, panel, core=20)
    plan = above_scan(hmm.updated_founders(panel, statistics))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
