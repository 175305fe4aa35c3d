"""What must not grow faster than its input: frames, copies of blocks, rows that leave a task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.operators import pedigree, relatedness, sinks, sites, transmission
from lociweave.sources import formats


def test_map_interpolation_carries_points_both_ways(spark):
    rng = np.random.default_rng(3)
    where = rng.choice(5000, 300, replace=False)
    points = [("c", int(p), float(p) ** 1.5) for p in where[:40]] + [("c", int(where[0]), 1e9)]
    wanted = [("c", int(p)) for p in [*where[20:], where[25]]] + [("d", 7)]
    out = sites.interpolated(spark.createDataFrame(wanted, "chrom string, pos long"), spark.createDataFrame(points, "chrom string, pos long, cm double"))
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    known = sorted((p, cm) for _, p, cm in points[:40])
    got = sorted((r.chrom, r.pos, r.cm) for r in out.where("chrom = 'c'").collect())
    want = sorted(("c", p, float(np.interp(p, *zip(*known)))) for _, p in wanted[:-1])
    assert [g[:2] for g in got] == [w[:2] for w in want]
    np.testing.assert_allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-12)
    assert out.where("chrom = 'd'").agg(F.count("cm"), F.count(F.lit(1))).first()[:] == (0, 1)


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of four samples and slices of three variants."""
    monkeypatch.setattr(relatedness, "BLOCK", 4)
    monkeypatch.setattr(relatedness, "SLICE", 3)


def gappy(spark, n=23, m=10):
    """Genotypes with gaps as an array and as rows; the last sample has one variant only."""
    rng = np.random.default_rng(8)
    g = rng.integers(0, 3, (n, m)).astype(float)
    g[rng.random((n, m)) < 0.2] = np.nan
    g[-1] = np.nan
    g[-1, 4] = 1.0
    rows = [(i, j, float(g[i, j])) for i in range(n) for j in range(m) if g[i, j] == g[i, j]]
    return g, spark.createDataFrame(rows, "id long, variant long, dosage double")


def test_blocks_meet_without_copies_in_a_shuffle(spark, small_blocks):
    g, long = gappy(spark)
    out = relatedness.grm(long)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    z = (g - np.nanmean(g, 0)) / np.nanstd(g, 0)
    s = np.nan_to_num(z) @ np.nan_to_num(z).T
    n = (g == g).astype(int) @ (g == g).astype(int).T
    want = {(a, b): (n[a, b], s[a, b]) for a in range(len(g)) for b in range(a, len(g)) if n[a, b]}
    got = {(r.a, r.b): (r.n, r.s) for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    kin = relatedness.king(long.withColumn("genotype", F.col("dosage")))
    assert "Exchange" not in kin._jdf.queryExecution().executedPlan().toString()
    for r in kin.collect():
        both = (g[r.a] == g[r.a]) & (g[r.b] == g[r.b])
        x, y = g[r.a][both], g[r.b][both]
        het = min((x == 1).sum(), (y == 1).sum())
        assert r.n == both.sum() and r.kinship == (None if not het else 0.5 * (1 - (abs(x - y) == 2).sum() / (2.0 * het)))
    assert relatedness.grm(long.limit(0)).count() == 0


@pytest.mark.parametrize("whole", [True, False])
def test_cityblock_with_and_without_gaps(spark, small_blocks, whole):
    g, long = gappy(spark)
    if whole:
        g = np.nan_to_num(g, nan=2.0)
        long = spark.createDataFrame([(i, j, float(x)) for (i, j), x in np.ndenumerate(g)], "id long, variant long, dosage double")
    out = relatedness.cityblock(long)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    gaps = abs(g[:, None] - g[None])
    want = {(a, b): (np.nansum(gaps[a, b]), (gaps[a, b] == gaps[a, b]).sum()) for a in range(len(g)) for b in range(a + 1, len(g)) if (gaps[a, b] == gaps[a, b]).any()}
    assert {(r.a, r.b): (r.sum_abs, r.n) for r in out.collect()} == want


def test_few_pairs_or_counts_leave_where_blocks_meet(spark, small_blocks):
    _, long = gappy(spark)
    every = {(r.a, r.b): r.r for r in relatedness.correlations(long).collect()}
    few = relatedness.correlations(long, least=0.2)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b): r.r for r in few.collect()} == {k: r for k, r in every.items() if r >= 0.2}
    want = {}
    for r in every.values():
        reached = max([c for c in (0.1, 0.3) if round(r, 3) >= c], default=-1.0)
        want[reached] = want.get(reached, 0) + 1
    assert {r.r: r.n for r in relatedness.correlation_bands(long, [0.3, 0.1], 3).collect()} == want


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("slices", [1, 4])
def test_loco_means_against_all_pairs(spark, monkeypatch, small_blocks, whole, slices):
    if slices == 1:
        monkeypatch.setattr(relatedness, "SLICE", 100)
    g, long = gappy(spark)
    if whole:
        long = spark.createDataFrame([(i, j, float(x)) for (i, j), x in np.ndenumerate(np.nan_to_num(g, nan=2.0))], "id long, variant long, dosage double")
    long = long.withColumn("grp", F.col("variant") % 3)
    sums = {}
    part, _ = relatedness.grm_by_group(long, "grp")
    rows = part.where("n > 0").collect()
    total = {}
    for r in rows:
        s, n = total.get((r.a, r.b), (0, 0))
        total[r.a, r.b] = s + r.s, n + r.n
    for r in rows:
        s, n = total[r.a, r.b]
        sums.setdefault((r.a, r.grp), []).append((s - r.s) / (n - r.n) if n > r.n else None)
    got = {(r.a, r.grp): (r.mean_loco, r.n_pairs) for r in relatedness.loco_means(long, "grp").collect()}
    assert got.keys() == sums.keys()
    for k, values in sums.items():
        known = [v for v in values if v is not None]
        assert got[k][1] == len(values)
        assert got[k][0] is None if not known else abs(got[k][0] - sum(known) / len(known)) < 1e-9


def test_lists_of_a_genotype_set_are_not_broadcast(spark, tmp_path):
    prefix = str(tmp_path / "set")
    samples = spark.createDataFrame([(s, "f", f"i{s}", "0", "0", "0", "-9") for s in range(5)], "sample_index long, fid string, iid string, father string, mother string, sex string, pheno string")
    variants = spark.createDataFrame([(v, "1", f"v{v}", 0.0, v + 1, "A", "G") for v in range(6)], "variant_index long, chrom string, snp string, cm double, pos long, a1 string, a2 string")
    dosages = spark.createDataFrame([(v, s, float((v + s) % 3)) for v in range(6) for s in range(5) if v + s != 4], "variant_index long, sample_index long, dosage double")
    sinks.write_genotype_set(dosages, samples, variants, prefix)
    out = formats.bed_at(spark, prefix, variants.where("pos < 5").select("chrom", "pos"))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.snp, r.iid): r.genotype for r in out.collect()} == {(f"v{v}", f"i{s}"): (v + s) % 3 if v + s != 4 else None for v in range(4) for s in range(5)}


def exchanges(df):
    """Exchanges of rows in a plan, and their keys; broadcasts do not count."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_what_relatives_are_told_stays_with_the_site(spark, monkeypatch):
    kin = spark.createDataFrame([(a, b, 0.25) for a in range(6) for b in range(6) if a != b], "a long, b long, kinship double")
    cells = spark.createDataFrame([(s, p, float(s), 1.0) for s in range(6) for p in range(4)], "sample_id long, pos long, dosage double, weight double")
    out = pedigree.kinship_prior(cells, kin)
    assert len(exchanges(out)) == 1
    got = sorted(map(tuple, out.collect()))
    assert got == [(s, p, (15 - s) / 5, 1.0) for s in range(6) for p in range(4)]
    monkeypatch.setattr(pedigree, "MOST_PAIRS", 3)
    assert sorted(map(tuple, pedigree.kinship_prior(cells, kin).collect())) == got


def test_rounds_of_messages_shuffle_cells_twice(spark, monkeypatch):
    cells = spark.createDataFrame([(s, "x", p, [0.2, 0.3, 0.5] if s % 2 else [0.7, 0.2, 0.1], s < 3) for s in range(6) for p in (1, 5, 9)], "sample_id long, chrom string, pos long, gp array<double>, supported boolean")
    trios = spark.createDataFrame([(2, 0, 1), (3, 0, 1), (4, 2, 3), (5, 2, None)], "child long, father long, mother long")
    kin = spark.createDataFrame([(2, 3, 0.25), (3, 2, 0.25), (4, 2, 0.25)], "a long, b long, kinship double")
    out = transmission.transmission_adjusted(cells, trios, kin, iterations=2)
    # by sample for the moving averages, and by site for messages and kin
    assert len(exchanges(out)) == 2
    got = {(r.sample_id, r.pos): r.gp for r in out.collect()}
    assert len(got) == 18
    monkeypatch.setattr(pedigree, "MOST_PAIRS", 0)
    for r in transmission.transmission_adjusted(cells, trios, kin, iterations=2).collect():
        np.testing.assert_allclose(r.gp, got[r.sample_id, r.pos], atol=1e-12)
