"""Messages between relatives and smoothing along chromosomes, against plain loops on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from lociweave.operators import calibration, transmission
from lociweave.plans import transmission_queries

CELLS = "sample_id long, chrom string, pos long, gp array<double>, supported boolean"


def test_smoothing_is_the_recurrence(spark):
    places = [3, 10, 11, 400, 90_000, 2_000_000]
    values = [0.1, 0.9, None, 0.4, 0.7, 0.2]
    rows = [(s, c, p, v) for s in (1, 2) for c in "xy" for p, v in zip(places, values, strict=True)]
    df = spark.createDataFrame(rows, "sample_id long, chrom string, pos long, value double")
    ages = spark.createDataFrame([(1, 50.0)], "sample_id long, generation double")
    got = {(r["sample_id"], r["chrom"], r["pos"]): r["smoothed"] for r in transmission.recombination_smoothed(df, ages, 1e-6).collect()}
    line = [(p, v) for p, v in zip(places, values, strict=True) if v is not None]
    for sample, age in ((1, 50.0), (2, 10.0)):
        def swept(track, age=age):
            out = [track[0][1]]
            for (p0, _), (p1, x) in zip(track, track[1:]):
                stay = math.exp(-age * abs(p1 - p0) * 1e-6)
                out.append(stay * out[-1] + (1 - stay) * x)
            return out

        ahead, behind = swept(line), swept(line[::-1])[::-1]
        for (p, _), f, b in zip(line, ahead, behind, strict=True):
            assert got[sample, "x", p] == pytest.approx((f + b) / 2, abs=1e-9) == got[sample, "y", p]
    assert len(got) == 4 * len(line)


def test_smoothing_tells_what_it_cannot_hold(spark):
    df = spark.createDataFrame([(1, "x", 0, 0.5), (1, "x", 10**9, 0.5)], "sample_id long, chrom string, pos long, value double")
    with pytest.raises(Exception, match="beyond 700"):
        transmission.recombination_smoothed(df, rate=1e-6).collect()


def test_latent_child_follows_its_parents(spark):
    alt, flat = [0.01, 0.01, 0.98], [1 / 3] * 3
    rows = [(1, "x", 5, alt, True), (2, "x", 5, alt, True), (3, "x", 5, flat, False), (4, "x", 5, flat, False), (9, "x", 5, None, None)]
    cells = spark.createDataFrame(rows, CELLS)
    pedigree = spark.createDataFrame([(3, 1, 2), (3, 1, 2), (4, None, None), (7, 1, 2)], "child long, father long, mother long")
    samples = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "sample_id long")
    out = {r["sample_id"]: r for r in transmission.adjusted(cells, pedigree, samples, "transmission", 0.7).collect()}
    assert sorted(out) == [1, 2, 3, 4]
    assert out[3]["dosage"] > 1.4 and out[4]["dosage"] == pytest.approx(1.0)
    assert out[1]["dosage"] > 1.9 and out[3]["mode"] == "transmission"
    near = {r["sample_id"]: r["dosage"] for r in transmission.adjusted(cells, pedigree, samples, "kinship", 0.5).collect()}
    assert near[3] > 1.05 and near[4] == pytest.approx(1.0)


def test_modes(spark):
    cells = spark.createDataFrame([(1, "x", 5, [0.0, 0.0, 1.0], True)], CELLS)
    pedigree = spark.createDataFrame([], "child long, father long, mother long")
    samples = cells.select("sample_id")
    told = lambda *a, **k: transmission.adjusted(cells, pedigree, samples, *a, **k).first()["mode"]
    assert [told("off", 1.0), told("kinship", 0.0), told("smooth", 0.2), told("kinship", 0.2, ploidy=4)] == ["off", "off", "smooth", "smooth_fallback"]
    with pytest.raises(ValueError, match="unknown"):
        told("other", 0.5)
    for mode in ("kinship", "transmission"):
        assert transmission.adjusted(cells.where("false"), pedigree, samples, mode, 0.5).count() == 0


def test_guard(spark):
    cells = spark.createDataFrame([(1, [0.0, 0.0, 1.0], [1.0, 0.0, 0.0])], "pos long, raw array<double>, gp array<double>")
    assert calibration.guarded(cells).first()["gp"] == [0.0, 0.0, 1.0]
    same = calibration.guarded(cells.withColumn("gp", F.col("raw"))).first()
    assert (same["status"], same["gp"]) == ("ok", [0.0, 0.0, 1.0])


def test_smoothing_works_values_out_once(spark, folder):
    """Leaving out nulls repeated all that made a value hundreds of times in a filter: F4 q_recombination_smoothing."""
    plan = transmission_queries.q_recombination_smoothing(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert max(map(len, plan.splitlines())) < 10_000 and plan.count("EXP") < 40
