"""Decisions without labels or thresholds that fit; classes with too few rows."""

from pyspark.sql import functions as F

from lociweave.operators import decisions

CELLS = "pos long, truth int, pred int, prob double, conf double, score double"


def test_nothing_to_learn_from(spark):
    cells = spark.createDataFrame([(p, -1, p % 3, 0.5, 0.9, -0.1) for p in range(5) for _ in range(4)], CELLS)
    sites = spark.createDataFrame([(p, p, p % 2) for p in range(5)], "pos long, site_index long, stratum int")
    out = decisions.by_level(cells, sites, [0.4, 0.6], 0.5).collect()
    assert len(out) == 5 and {(r.calibration_used, r.decision_source, r.fallback_reason, r.threshold, r.call_rate_delta) for r in out} == {(False, "raw_no_call", "insufficient_labels", 0.5, 0.0)}
    classes = sites.select("pos", F.col("stratum").alias("class_id"))
    out = decisions.thresholds_by_class(cells, classes, [-0.5, -0.2]).collect()
    assert {(r.class_id, r.n_variants, r.n_train_rows, r.threshold, r.fallback_to_global) for r in out} == {(0, 3, 0, float("-inf"), True), (1, 2, 0, float("-inf"), True)}
    assert decisions.by_level(cells.limit(0), sites.limit(0), [0.4], 0.5).count() == 0


def test_a_finer_level_takes_the_place_of_a_coarser_one(spark):
    """Wrong calls have low probability at site 1 only: its own threshold is used there, that of all sites elsewhere."""
    rows = [(0, t, t, 0.9, 0.9, 0.0) for t in (0, 1, 2, 2, 1, 0) * 4] + [(1, t, t, 0.9, 0.9, 0.0) for t in (0, 1, 2) * 8] + [(1, 0, 1, 0.3, 0.9, 0.0)]
    cells = spark.createDataFrame(rows, CELLS)
    sites = spark.createDataFrame([(0, 0, 0), (1, 1, 0)], "pos long, site_index long, stratum int")
    out = {r.pos: r for r in decisions.by_level(cells, sites, [0.2, 0.5], 0.5, min_rows=6, rate_delta=(-0.1, 0.1)).collect()}
    assert out[1].decision_source == "per_snp:1" and out[1].threshold == 0.5 and out[1].objective_delta > 0 and out[1].call_rate_calibrated == 24 / 25
    assert out[0].decision_source == "per_snp:0" and out[0].threshold == 0.2 and out[0].objective_delta == 0


def test_a_class_below_the_least_rows_takes_the_threshold_of_all(spark):
    rows = [(0, t, p, 0.0, 0.0, s) for t, p, s in [(0, 0, -0.1), (1, 1, -0.1), (2, 2, -0.1), (0, 1, -0.9)] * 8] + [(1, 1, 1, 0.0, 0.0, -0.1)] * 3
    cells = spark.createDataFrame(rows, CELLS)
    classes = spark.createDataFrame([(0, 7), (1, 8)], "pos long, class_id int")
    out = {r.class_id: r for r in decisions.thresholds_by_class(cells, classes, [float("-inf"), -0.5]).collect()}
    assert out[8].threshold == -0.5 and out[8].fallback_to_global and out[8].n_train_rows == 3 and out[8].train_f1 is None
    assert out[7].n_train_rows == 32 and out[7].threshold == -0.5
    kept = decisions.thresholds_by_class(cells, classes, [float("-inf"), -0.5], max_no_call_rate=0.2).where("class_id = 7").first()
    assert kept.fallback_to_global  # a quarter of the site's cells would go, so the class keeps what all sites have


def test_cells_are_worked_out_once(spark, monkeypatch):
    from lociweave.plans import decision_queries, domain

    seen = []
    monkeypatch.setattr(domain, "reads", lambda *a, reads=domain.reads: seen.append(a) or reads(*a))
    cells, sites = decision_queries._level_inputs(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and "lineitem" not in str(cells.inputFiles() + sites.inputFiles())


def test_groups_of_sites_are_not_broadcast(spark):
    """The levels' groups are more than the sites, and all went to the driver: F13 q_hierarchical_decisions."""
    cells = spark.createDataFrame([(p, p % 3, p % 3, 0.5, 0.9, -0.1) for p in range(5) for _ in range(4)], CELLS)
    sites = spark.createDataFrame([(p, p, p % 2) for p in range(5)], "pos long, site_index long, stratum int")
    out = decisions.by_level(cells, sites, [0.4, 0.6], 0.5)
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString() and out.count() == 5
