"""Held-out predictions in one job against a job for each fold."""

import pytest
from pyspark.sql import functions as F

from lociweave.operators import crossvalidation as cv
from lociweave.operators import evidence as ev
from lociweave.operators import hmm, models
from lociweave.plans import crossvalidation_queries, domain


def test_folds_together_equal_folds_alone(spark, folder):
    evidence = ev.evidence_counts(ev.usable(domain.reads(spark, folder))).persist()
    positions, samples, panel = domain.positions(spark, folder), domain.samples(spark, folder), domain.founders(spark, folder)
    folds = models.folds(positions, 2, F.col("pos") * 7919 % 1009).select("pos", "fold")
    got = {(r.fold, r.sample_id, r.pos): r.dosage for r in cv.held_out_predictions(evidence, positions, samples, panel, folds, 2).collect()}
    want = {}
    for k in range(2):
        seen = evidence.join(folds.where(F.col("fold") != k), "pos").drop("fold")
        alone = hmm.posteriors(seen, positions, samples, panel).join(folds.where(F.col("fold") == k), "pos")
        want |= {(k, r.sample_id, r.pos): r.dosage for r in alone.collect()}
    assert got.keys() == want.keys() and max(abs(got[c] - want[c]) for c in want) < 1e-9


def test_pseudo_truth(spark):
    rows = spark.createDataFrame([(1, 5, 1.5), (1, 6, 2.7), (1, 7, None), (1, 5, 0.2), (1, 8, 0.5)], "sample_id long, pos int, dosage double")
    assert sorted(map(tuple, cv.pseudo_truth(rows).collect())) == [(1, 5, 0, 0.0), (1, 6, 2, 2.0), (1, 8, 0, 0.0)]
    both = rows.withColumn("genotype", F.lit(1)).withColumn("dosage_truth", F.col("dosage"))
    assert {r.genotype_truth for r in cv.pseudo_truth(both).collect()} == {1}
    with pytest.raises(ValueError, match="pseudo-truth"):
        cv.pseudo_truth(rows.drop("dosage"))


def test_scores_scan_once(spark, folder):
    """Accuracies and read log-likelihoods each scanned all folds: F14."""
    plan = crossvalidation_queries.q_cv_harness(spark, folder)._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMap" not in plan and "written-" in plan
