"""Mixed models against dense NumPy, and distributions against numbers from tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.functions.distributions import neglog_erfc, neglog_t
from lociweave.operators import mixedmodels as mm
from lociweave.operators import relatedness


def test_tails_against_tables():
    """Published quantiles of t, and closed forms for one and two degrees of freedom."""
    for t, df, p in ((12.706205, 1, 0.05), (4.302653, 2, 0.05), (2.570582, 5, 0.05), (2.228139, 10, 0.05), (3.169273, 10, 0.01), (2.042272, 30, 0.05), (1.983972, 100, 0.05)):
        assert 10 ** -neglog_t(t, df) == pytest.approx(p, rel=2e-6)
    x = np.array([0.0, 0.3, 2.0, 50.0, 1e6])
    assert neglog_t(x, 1) == pytest.approx(-np.log10(1 - 2 / np.pi * np.arctan(x)), rel=1e-7, abs=1e-12)
    assert neglog_t(x[:4], 2) == pytest.approx(-np.log10(1 - x[:4] / np.sqrt(2 + x[:4] ** 2)), rel=1e-7, abs=1e-12)
    assert np.isnan(neglog_t(np.array([np.nan, 1.0]), np.array([5.0, 0.0]))).all()
    assert neglog_t(40.0, 10000.0) == pytest.approx(322.4, abs=3)  # far below the smallest double
    assert neglog_erfc(np.array([0.0, 1.0, 5.0])) == pytest.approx([0.0, 0.803275, 11.813196], abs=2e-6)
    assert neglog_erfc(np.array([19.999999, 20.000001])) == pytest.approx([175.2680] * 2, abs=1e-3)


def case(spark, n=60, m=30, seed=1, missing=0.05):
    rng = np.random.default_rng(seed)
    family = rng.integers(0, 6, n)
    centre = rng.random((6, m)) * 2
    x = np.clip(np.round(centre[family] + rng.normal(size=(n, m)) * 0.6), 0, 2)
    x[:, 5] = 1.0  # no spread
    x[rng.random((n, m)) < missing] = np.nan
    rows = [(int(10 * i), int(3 * j), float(x[i, j]) if x[i, j] == x[i, j] else None, f"c{j % 3}") for i in range(n) for j in range(m)]
    y = np.stack([np.nansum(x[:, :4], 1) + rng.normal(size=n), rng.normal(size=n)], 1)
    y[::7, 1] = np.nan
    traits = [(int(10 * i), t, float(y[i, k]) if y[i, k] == y[i, k] else None) for i in range(n) for k, t in enumerate("pq")]
    return x, y, spark.createDataFrame(rows, "id long, variant long, dosage double, grp string"), spark.createDataFrame(traits, "id long, trait string, value double")


def scaled(x):
    mean, sd = np.nanmean(x, 0), np.nanstd(x, 0)
    return np.where(np.isnan(x), 0.0, (x - mean) / np.where(sd > 0, sd, np.inf))


def eigen(z):
    s, u = np.linalg.eigh(z @ z.T / (z.shape[1] - 1))
    keep = s > 1e-9 * s.max()
    return u[:, keep][:, ::-1], s[keep][::-1]


def fitted(u, s, y):
    """(h2, likelihood, sp, ...) on a fine grid, by the definition."""
    seen = ~np.isnan(y)
    u, y = u[seen], y[seen]
    s = np.maximum(s * (u**2).sum(0), 1e-8)
    r2, sp = (u.T @ (y - y.mean())) ** 2, y.var(ddof=1)
    h = np.linspace(0, 1, 200_001)[:, None]

    def likelihood(h):
        v = h * sp * s + (1 - h) * sp
        return -0.5 * ((r2 / v).sum(1) + np.log(v).sum(1) + len(y) * np.log(2 * np.pi)) - 0.5 * np.log((1 / v).sum(1))

    with np.errstate(divide="ignore"):
        values = likelihood(h)
    return h[values.argmax(), 0], values.max(), values[0]


def small(monkeypatch):
    monkeypatch.setattr(mm, "TILE_SAMPLES", 16)
    monkeypatch.setattr(mm, "TILE_VARIANTS", 8)


def test_eigenvectors_of_all_runs(spark, monkeypatch):
    small(monkeypatch)
    x, _, long, _ = case(spark)
    u, s = mm.eigenvectors(mm.standardised(long, groups=True), 40, leave_out=True)
    vectors = {}
    for r in u.collect():
        vectors.setdefault(r.run, {})[r.id] = r.u
    values = {run: [r.s for r in sorted(s.where(F.col("run") == run).collect(), key=lambda r: r.k)] for run in vectors}
    z = scaled(x)
    assert set(vectors) == {"all", "c0", "c1", "c2"}
    for run in vectors:
        part = z if run == "all" else z[:, [j for j in range(z.shape[1]) if f"c{j % 3}" != run]]
        want_u, want_s = eigen(part)
        got = np.array([vectors[run][10 * i] for i in range(len(z))])
        assert values[run] == pytest.approx(want_s, rel=1e-8) and np.abs(got.T @ got - np.eye(got.shape[1])).max() < 1e-8
        assert np.abs((got * values[run]) @ got.T - part @ part.T / (part.shape[1] - 1)).max() < 1e-8


def test_leading_components_of_a_larger_matrix(spark, monkeypatch):
    """A rank far beyond the sketch: the leading eigenvalues come out by subspace iterations."""
    small(monkeypatch)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4)) @ rng.normal(size=(4, 90)) * 2 + rng.normal(size=(120, 90))
    long = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(120) for j in range(90)], "id long, variant long, dosage double")
    _, s = mm.eigenvectors(mm.standardised(long), 4)
    assert [r.s for r in sorted(s.collect(), key=lambda r: r.k)] == pytest.approx(eigen(scaled(x))[1][:4], rel=1e-6)
    pc = {r.id: r.pc for r in mm.principal_components(long, 2).collect()}
    c = x - x.mean(0)
    _, v = np.linalg.eigh(c.T @ c)
    assert np.abs(np.abs([pc[i] for i in range(120)]) - np.abs(c @ v[:, ::-1][:, :2])).max() < 1e-4


def test_heritability_whitening_and_prediction(spark):
    x, y, long, traits = case(spark)
    u, s = mm.eigenvectors(mm.standardised(long), 60)
    parts = mm.rotated(u, s, traits)
    h2 = mm.heritability(parts)
    got = {r.trait: r for r in h2.collect()}
    wu, ws = eigen(scaled(x))
    for k, t in enumerate("pq"):
        want, top, none = fitted(wu, ws, y[:, k])
        assert got[t].p == pytest.approx(math.erfc(math.sqrt(max(top - none, 0.0))), abs=1e-6)
        assert got[t].h2 == pytest.approx(want, abs=2e-5) and got[t].likelihood == pytest.approx(top, abs=1e-7) and 0 <= got[t].p <= 1
    assert got["p"].h2 > 0.3 and got["p"].p < 0.05
    for how in ("ystar", "blup", "blup_resid"):
        rows = {(r.trait, r.id): r.value for r in mm.corrected(u, parts, h2, how, traits).collect()}
        for k, t in enumerate("pq"):
            seen = ~np.isnan(y[:, k])
            h, r = got[t].h2, wu[seen].T @ y[seen, k]
            own = ws * (wu[seen] ** 2).sum(0)
            want = wu @ (r / np.sqrt(y[seen, k].var() * (h * own + 1 - h))) if how == "ystar" else wu @ (r * h * own / (h * own + 1 - h))
            if how == "blup_resid":
                want = y[:, k] - want
            assert all(rows[t, 10 * i] == pytest.approx(want[i], abs=1e-6) for i in range(len(y)) if how != "blup_resid" or seen[i])
    with pytest.raises(ValueError, match="unknown correction"):
        mm.corrected(u, parts, h2, "none", traits)


@pytest.mark.parametrize("stat,sided", [("ttest", "two-sided"), ("wald", "one-sided"), ("score", "two-sided")])
def test_association(spark, stat, sided):
    x, y, long, traits = case(spark, seed=3)
    out = {(r.variant, r.trait): r for r in mm.scaled_association(mm.standardised(long), traits, stat, sided).collect()}
    assert len(out) == 60
    z = scaled(x)
    for j in range(z.shape[1]):
        for k, t in enumerate("pq"):
            got, seen = out[3 * j, t], ~np.isnan(x[:, j]) & ~np.isnan(y[:, k])
            v = (y[:, k] - np.nanmean(y[:, k])) / np.nanstd(y[:, k])
            a, b, dof = z[seen, j], v[seen], seen.sum() - 1
            if j == 5:
                assert got.beta is None and got.neglog_p is None
                continue
            beta = a @ b / (a @ a)
            se = np.sqrt((b @ b - (0 if stat == "score" else beta * beta * (a @ a))) / dof / (a @ a))
            assert (got.beta, got.beta_se, got.dof) == pytest.approx((beta, se, dof), abs=1e-9)
            assert got.stat == pytest.approx(beta / se if stat == "ttest" else (beta / se) ** 2, abs=1e-8)
            p = neglog_t(beta / se, dof) if stat == "ttest" else neglog_erfc(abs(beta / se) / np.sqrt(2))
            assert got.neglog_p == pytest.approx(float(p) + (np.log10(2) if sided == "one-sided" else 0), abs=1e-8)


def test_gwas_leaving_groups_out(spark):
    x, y, long, traits = case(spark, seed=4, missing=0.0)
    out = {(r.variant, r.trait): r for r in mm.gwas(long, traits.where("trait = 'p'"), 60).collect()}
    z = scaled(x)
    for g in range(3):
        rest = z[:, [j for j in range(30) if j % 3 != g]]
        u, s = eigen(rest)
        h, _, _ = fitted(u, s, y[:, 0])
        v = u @ ((u.T @ y[:, 0]) / np.sqrt(y[:, 0].var() * (h * s + 1 - h)))
        v = (v - v.mean()) / v.std()
        for j in range(g, 30, 3):
            if j != 5:
                assert out[3 * j, "p"].beta == pytest.approx(z[:, j] @ v / (z[:, j] @ z[:, j]), abs=1e-4)
    assert {r.dof for r in out.values()} == {59}


def test_pairs_by_blocks(spark, monkeypatch):
    """Leave-one-group-out relationships and linkage in several blocks and slices, with gaps, against dense NumPy."""
    monkeypatch.setattr(relatedness, "BLOCK", 7)
    monkeypatch.setattr(relatedness, "SLICE", 11)
    x, _, long, _ = case(spark, n=25, m=18)
    part, out = relatedness.grm_by_group(long, "grp")
    z, known = scaled(x), (~np.isnan(x)).astype(float)
    sums = np.stack([z[:, g::3] @ z[:, g::3].T for g in range(3)]), np.stack([known[:, g::3] @ known[:, g::3].T for g in range(3)])
    rows = out.collect()
    assert len(rows) == 25 * 26 // 2 * 3
    for r in rows:
        a, b, g = r.a // 10, r.b // 10, int(r.grp[1])
        s, n = sums[0][:, a, b], sums[1][:, a, b]
        assert (r.s, r.n, r.loco) == pytest.approx((s[g], n[g], (s.sum() - s[g]) / (n.sum() - n[g])), abs=1e-9)
    for r in relatedness.linkage(long).collect():
        seen = ~np.isnan(x[:, r.a // 3]) & ~np.isnan(x[:, r.b // 3])
        p, q = x[seen, r.a // 3], x[seen, r.b // 3]
        assert r.n == seen.sum() and r.cov == pytest.approx((p * q).mean() - p.mean() * q.mean(), abs=1e-9)
        assert r.r is None if p.std() < 1e-6 or q.std() < 1e-6 else r.r == pytest.approx(np.corrcoef(p, q)[0, 1], abs=1e-8)
    some = spark.createDataFrame([(0,), (30,), (240,)], "id long")
    every = {(r.a, r.b): r.r for r in relatedness.correlations(long).collect()}
    few = {(r.a, r.b): r.r for r in relatedness.correlations(long, some).collect()}
    assert set(few) == {(0, 30), (0, 240), (30, 240)} and all(every[k] == pytest.approx(v) for k, v in few.items())
