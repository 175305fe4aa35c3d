"""Queries of genotype posteriors and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import calibration as cal
from lociweave.operators import evidence as ev
from lociweave.operators import posterior as gp
from lociweave.plans import domain
from lociweave.plans.domain import with_tables
from lociweave.plans.evidence_queries import COUNTS, TRUTH, USABLE

THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
BINS = {"maf": (0.0, 0.1, 0.2, 0.3, 0.4, 0.5), "info": (-5.0, -0.2, 0.0, 0.2, 1.0), "mean_depth": (0.0, 1.2, 1.5, 2.0, 100.0)}
MAF_EDGES = (0.0, 0.3, 0.4, 0.5)


def cells(spark, folder, *more):
    """sample_id, pos, depth, truth, dosage, raw and calibrated gp of every covered cell, and `more` columns of its evidence."""
    e = ev.truth_labels(ev.evidence_counts(ev.usable(domain.reads(spark, folder))))
    ds = 2 * (F.col("alt_weight") + 0.5) / (F.col("ref_weight") + F.col("alt_weight") + 1)
    return gp.modelled(e.select("sample_id", "pos", "depth", "truth", ds.alias("dosage"), *more), 0.35)


def _three(df, column, *keys):
    return df.select(*keys, *[F.round(F.get(column, F.lit(g)), 8).alias(f"g{g}") for g in range(3)])


def q_gp_from_dosage(spark, folder):
    return _three(cells(spark, folder), "soft", "sample_id", "pos")


def q_gp_blend(spark, folder):
    return _three(cells(spark, folder), "gp", "sample_id", "pos")


def q_hwe_tilt(spark, folder):
    """Posteriors tilted by half a Hardy-Weinberg prior of their site's allele frequency."""
    c = cells(spark, folder)
    af = gp.site_statistics(c).select("pos", "alt_af")
    tilt = gp.tilted(F.col("gp"), gp.hwe_prior(F.col("alt_af")), 0.5)
    return _three(c.join(af, "pos").withColumn("tilt", tilt), "tilt", "sample_id", "pos")


def q_confidence(spark, folder):
    g = F.col("gp")
    return cells(spark, folder).select(
        "sample_id", "pos", F.round(gp.confidence(g), 8).alias("max_gp"), F.round(gp.margin(g), 8).alias("margin"), F.round(gp.entropy(g), 8).alias("entropy")
    )


def q_call_modes(spark, folder):
    """Calls and the five scores of certainty."""
    g = F.col("gp")
    names = ("max_gp", "log_max_gp", "margin", "neg_entropy", "log_max_gp_minus_entropy")
    return cells(spark, folder).select(
        "sample_id", "pos", gp.call(g, 0.6, 0.2).cast("int").alias("call"), *[F.round(gp.call_score(g, m), 7).alias(f"s_{m}") for m in names]
    )


def q_info(spark, folder):
    """Allele frequency, MAF, INFO and Hardy-Weinberg statistics of each site."""
    out = gp.site_statistics(cells(spark, folder))
    return out.select("pos", "n", *[F.round(c, 7).alias(c) for c in ("alt_af", "maf", "info", "hwe_deviation", "hwe_chisq")])


def q_hwe_pvalue(spark, folder):
    """Hardy-Weinberg p-values and their negative logs."""
    out = gp.site_statistics(cells(spark, folder)).select("pos", F.round("hwe_chisq", 7).alias("x"))
    p = gp.chi_square_p(F.col("x"))
    return out.select("pos", F.round(p, 7).alias("p"), F.round(-F.log10(gp.clipped(p, 1e-30, 1.0)), 5).alias("neg_log10_p"))


def q_nll_brier(spark, folder):
    out = gp.losses(cells(spark, folder))
    return out.select("n", *[F.round(c, 7).alias(c) for c in ("nll", "brier", "dosage_mse")])


def q_shift_metrics(spark, folder):
    out = gp.shifts(cells(spark, folder))
    return out.select(*[F.round(c, 7).alias(c) for c in out.columns])


def q_mask_ploidy(spark, folder):
    """Posteriors of male samples restricted to one allele."""
    p = domain.samples(spark, folder).select("sample_id", F.when(F.col("sex") == "male", 1).otherwise(2).alias("ploidy"))
    c = cells(spark, folder).join(F.broadcast(p), "sample_id").withColumn("m", gp.masked_by_ploidy(F.col("gp"), F.col("ploidy")))
    return _three(c, "m", "sample_id", "pos")


def _sites(spark, folder):
    c = cells(spark, folder)
    depth = c.groupBy("pos").agg(F.avg("depth").alias("mean_depth"))
    return gp.site_statistics(c).join(depth, "pos")


def q_strata(spark, folder):
    rounded = _sites(spark, folder).select("pos", *[F.round(c, 7).alias(c) for c in ("maf", "info", "mean_depth")])
    return cal.strata(rounded, BINS).groupBy("stratum").agg(F.count(F.lit(1)).alias("n_sites"))


def q_no_call_cap(spark, folder):
    c = cells(spark, folder).withColumn("gp", F.transform("gp", lambda x: F.round(x, 7)))
    out = cal.capped_calls(c, -0.5, 0.1)
    return out.groupBy("pos").agg(F.count_if(F.col("call") < 0).alias("n_missing"), F.count(F.lit(1)).alias("n"))


def _predicted(spark, folder):
    g = F.col("gp")
    return cells(spark, folder).select("pos", "truth", gp.argmax(g).alias("pred"), F.round(gp.confidence(g), 7).alias("prob"))


def q_threshold_scan(spark, folder):
    out = cal.threshold_scan(_predicted(spark, folder), THRESHOLDS)
    return out.select("threshold", *[F.round(c, 8).alias(c) for c in ("call_rate", "macro_f1", "balanced_accuracy", "objective")], "best")


def q_f1_bacc(spark, folder):
    """Agreement of calls with truth in each decile of positions."""
    rows = _predicted(spark, folder).withColumn("decile", F.floor(F.col("pos") % 10).cast("int"))
    out = cal.agreement(cal.confusion(rows, "decile"), "decile")
    return out.select("decile", "n_called", F.round("macro_f1", 8).alias("macro_f1"), F.round("balanced_accuracy", 8).alias("balanced_accuracy"))


def q_hardcall_stats(spark, folder):
    g = F.col("gp")
    calls = cells(spark, folder).select("pos", gp.call(F.transform(g, lambda x: F.round(x, 7)), 0.6).alias("call"))
    out = cal.call_statistics(calls)
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


def q_context_features(spark, folder):
    """Local mean and deviation of MAF in windows of five sites."""
    s = _sites(spark, folder).join(domain.positions(spark, folder).select("chrom", "pos"), "pos").withColumn("maf", F.round("maf", 7))
    return cal.context(s, "maf", 2).select("chrom", "pos", F.round("local_mean", 6).alias("local_mean"), F.round("local_std", 5).alias("local_std"))


def q_masked_cv_grid(spark, folder):
    c = cells(spark, folder)
    s = gp.site_statistics(c).select("pos", F.round("alt_af", 7).alias("alt_af"), F.round("maf", 7).alias("maf"))
    return cal.masked_grid(c.join(s, "pos"), [0.2, 0.35, 0.5], [0.2, 0.5], [0.0, 0.3], MAF_EDGES)


QUERIES = {f.__name__: f for f in (
    q_gp_from_dosage, q_gp_blend, q_hwe_tilt, q_confidence, q_call_modes, q_info, q_hwe_pvalue, q_nll_brier, q_shift_metrics, q_mask_ploidy, q_strata,
    q_no_call_cap, q_threshold_scan, q_f1_bacc, q_hardcall_stats, q_context_features, q_masked_cv_grid,
)}


def _clip(x):
    return f"least(1.0::double, greatest(1e-6::double, {x}))"


def _norm(names, sources, extra="*"):
    """Columns `names` from expressions `sources`, clipped and normalised; to be used as a select list."""
    whole = " + ".join(_clip(s) for s in sources)
    return f"{extra}, " + ", ".join(f"({_clip(s)}) / greatest({whole}, 1e-12) as {n}" for n, s in zip(names, sources, strict=True))


CELLS = f"""c0 as (
  select sample_id, pos, depth, truth, 2 * (alt_weight + 0.5::double) / (ref_weight + alt_weight + 1) as ds from labelled),
c1 as (select *, (1 - ds / 2) * (1 - ds / 2) as r0, 2 * (ds / 2) * (1 - ds / 2) as r1, (ds / 2) * (ds / 2) as r2,
  greatest(1e-6::double, 0.35 / sqrt(depth + 1.0)) as heat from c0),
c2 as (select *, -pow(ds, 2) / heat as l0, -pow(ds - 1, 2) / heat as l1, -pow(ds - 2, 2) / heat as l2 from c1),
c3 as (select *, exp(l0 - greatest(l0, l1, l2)) as e0, exp(l1 - greatest(l0, l1, l2)) as e1, exp(l2 - greatest(l0, l1, l2)) as e2 from c2),
c4 as (select {_norm(("s0", "s1", "s2"), [f"e{g} / (e0 + e1 + e2)" for g in range(3)])} from c3),
cells as materialized (select {_norm(("g0", "g1", "g2"), [f"(0.65 * r{g} + 0.35 * s{g})" for g in range(3)])} from c4)"""
_ENT = " + ".join(f"-greatest(1e-12::double, {{0}}{g}) * ln(greatest(1e-12::double, {{0}}{g}))" for g in range(3))


def entropy_sql(prefix):
    return f"(({_ENT.format(prefix)}) / ln(3.0::double))"


_ARG = "case when g0 >= g1 and g0 >= g2 then 0 when g1 >= g2 then 1 else 2 end"
_MAX = "greatest(g0, g1, g2)"
_MARGIN = "(greatest(g0, g1, g2) - (g0 + g1 + g2 - greatest(g0, g1, g2) - least(g0, g1, g2)))"
SITES = f"""sites as materialized (
  select pos, n, af as alt_af, least(af, 1 - af) as maf, mean_depth,
    case when 2 * af * (1 - af) > 1e-8 then least(1.0::double, greatest(-5.0::double, 1 - v / (2 * af * (1 - af)))) end as info,
    sqrt((pow(t0 / m - x0, 2) + pow(t1 / m - x1, 2) + pow(t2 / m - x2, 2)) / 3) as hwe_deviation,
    pow(t0 - x0 * m, 2) / greatest(1e-6, x0 * m) + pow(t1 - x1 * m, 2) / greatest(1e-6, x1 * m) + pow(t2 - x2 * m, 2) / greatest(1e-6, x2 * m) as hwe_chisq
  from (select {_norm(("x0", "x1", "x2"), ["(1 - p) * (1 - p)", "2 * p * (1 - p)", "p * p"])}, greatest(1e-6, t0 + t1 + t2) as m from (
    select *, least(1 - 1e-6::double, greatest(1e-6::double, af)) as p from (
      select pos, count(*) as n, avg(g1 + 2 * g2) / 2 as af, avg(greatest(0, g1 + 4 * g2 - (g1 + 2 * g2) * (g1 + 2 * g2))) as v,
             sum(g0) as t0, sum(g1) as t1, sum(g2) as t2, avg(depth) as mean_depth from cells group by 1))))"""


def _sql(body, sites=False):
    return with_tables("reads", f"{USABLE},\n{COUNTS},\n{TRUTH},\n{CELLS}{',' + chr(10) + SITES if sites else ''}{body}")


_PRED = f""",
pred as (select pos, truth, {_ARG} as pred, round({_MAX}, 7) as prob from cells)"""


def _agree(keys, source):
    """Agreement by `keys` from rows (keys, truth, pred)."""
    on = f"{keys}, " if keys else ""
    return f""",
k as (select * from {source} where truth >= 0 and pred >= 0),
t as (select {on}truth as cls, count(*) as n_true, count(*) filter (where truth = pred) as tp from k group by all),
q as (select {on}pred as cls, count(*) as n_pred from k group by all),
b as (select {on}cls, coalesce(n_true, 0) as n_true, coalesce(n_pred, 0) as n_pred, coalesce(tp, 0) as tp from t full join q using ({on}cls)),
agreed as (select {on}avg(2 * tp / (n_true + n_pred)::double) as macro_f1, avg(case when n_true > 0 then tp / n_true::double end) as balanced_accuracy,
  sum(n_true)::bigint as n_called from b group by all)"""


def _grid_sql():
    mixes = [f"((1 - blend) * r{g} + blend * z{g})" for g in range(3)]
    ep = [f"exp(ln({_clip(f'm{g}')}) + prior_weight * ln({_clip(f'x{g}')}))" for g in range(3)]
    return f""",
grid as (select * from unnest([0.2::double, 0.35, 0.5]) a(temperature), unnest([0.2::double, 0.5]) b(blend), unnest([0.0::double, 0.3]) d(prior_weight)),
h0 as (select c.* exclude (heat, l0, l1, l2, e0, e1, e2), temperature, blend, prior_weight, round(maf, 7) as maf, round(alt_af, 7) as af,
   greatest(1e-6::double, temperature / sqrt(depth + 1.0)) as heat from cells c join sites using (pos), grid where truth >= 0),
h1 as (select *, -pow(ds, 2) / heat as l0, -pow(ds - 1, 2) / heat as l1, -pow(ds - 2, 2) / heat as l2 from h0),
h2 as (select *, exp(l0 - greatest(l0, l1, l2)) as e0, exp(l1 - greatest(l0, l1, l2)) as e1, exp(l2 - greatest(l0, l1, l2)) as e2 from h1),
h3 as (select {_norm(("z0", "z1", "z2"), [f"e{g} / (e0 + e1 + e2)" for g in range(3)])} from h2),
h4 as (select {_norm(("m0", "m1", "m2"), mixes)}, least(1 - 1e-6::double, greatest(1e-6::double, af)) as p from h3),
h5 as (select {_norm(("x0", "x1", "x2"), ["(1 - p) * (1 - p)", "2 * p * (1 - p)", "p * p"])} from h4),
h6 as (select {_norm(("f0", "f1", "f2"), ep)} from h5),
o as (select (maf >= 0.3)::int + (maf >= 0.4)::int as maf_bin, temperature, blend, prior_weight, count(*) as n,
  round(avg(-ln(greatest(1e-6, case truth when 0 then f0 when 1 then f1 else f2 end)))
   + 0.25 * avg((pow(f0 - (truth = 0)::int, 2) + pow(f1 - (truth = 1)::int, 2) + pow(f2 - (truth = 2)::int, 2)) / 3)
   + 0.1 * avg(pow(f1 + 2 * f2 - truth, 2)), 8) as objective from h6 group by all)
select *, row_number() over (partition by maf_bin order by objective, temperature, blend, prior_weight) = 1 as best from o"""


ORACLE_SQL = {
    "q_gp_from_dosage": _sql("\nselect sample_id, pos, round(s0, 8) as g0, round(s1, 8) as g1, round(s2, 8) as g2 from cells"),
    "q_gp_blend": _sql("\nselect sample_id, pos, round(g0, 8) as g0, round(g1, 8) as g1, round(g2, 8) as g2 from cells"),
    "q_hwe_tilt": _sql(f""",
y as (select sample_id, pos, g0, g1, g2, least(1 - 1e-6::double, greatest(1e-6::double, alt_af)) as p from cells join sites using (pos)),
y1 as (select {_norm(("x0", "x1", "x2"), ["(1 - p) * (1 - p)", "2 * p * (1 - p)", "p * p"])} from y),
y2 as (select {_norm(("t0", "t1", "t2"), [f"exp(ln({_clip(f'g{g}')}) + 0.5 * ln({_clip(f'x{g}')}))" for g in range(3)])} from y1)
select sample_id, pos, round(t0, 8) as g0, round(t1, 8) as g1, round(t2, 8) as g2 from y2""", True),
    "q_confidence": _sql(f"\nselect sample_id, pos, round({_MAX}, 8) as max_gp, round({_MARGIN}, 8) as margin, round({entropy_sql('g')}, 8) as entropy from cells"),
    "q_call_modes": _sql(f"""
select sample_id, pos, case when {_MAX} >= 0.6 and {_MARGIN} >= 0.2 then {_ARG} else -1 end as call, round({_MAX}, 7) as s_max_gp,
       round(ln({_MAX}), 7) as s_log_max_gp, round({_MARGIN}, 7) as s_margin, round(-{entropy_sql('g')}, 7) as s_neg_entropy,
       round(ln({_MAX}) - {entropy_sql('g')}, 7) as s_log_max_gp_minus_entropy from cells"""),
    "q_info": _sql("""
select pos, n, round(alt_af, 7) as alt_af, round(maf, 7) as maf, round(info, 7) as info, round(hwe_deviation, 7) as hwe_deviation,
       round(hwe_chisq, 7) as hwe_chisq from sites""", True),
    "q_hwe_pvalue": _sql("""
, x as (select pos, round(hwe_chisq, 7) as x from sites),
t as (select pos, sqrt(greatest(x, 0.0::double) / 2) as z, 1 / (1 + 0.3275911::double * sqrt(greatest(x, 0.0::double) / 2)) as t from x),
p as (select pos, ((((1.061405429::double * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z) as p from t)
select pos, round(p, 7) as p, round(-log10(least(1.0::double, greatest(1e-30::double, p))), 5) as neg_log10_p from p""", True),
    "q_nll_brier": _sql("""
select count(*) as n, round(avg(-ln(greatest(1e-6, case truth when 0 then g0 when 1 then g1 else g2 end))), 7) as nll,
       round(avg((pow(g0 - (truth = 0)::int, 2) + pow(g1 - (truth = 1)::int, 2) + pow(g2 - (truth = 2)::int, 2)) / 3), 7) as brier,
       round(avg(pow(g1 + 2 * g2 - truth, 2)), 7) as dosage_mse from cells where truth >= 0"""),
    "q_shift_metrics": _sql(f""",
a as (select pos, avg(r1 + 2 * r2) / 2 as x, avg(g1 + 2 * g2) / 2 as y from cells group by 1)
select round(avg(abs(g1 + 2 * g2 - r1 - 2 * r2)), 7) as mean_abs_dosage_shift, round(avg({entropy_sql('g')}) - avg({entropy_sql('r')}), 7) as mean_entropy_shift,
       round(avg(abs({entropy_sql('g')} - {entropy_sql('r')})), 7) as mean_abs_entropy_shift, round(avg(g1) - avg(r1), 7) as het_rate_shift,
       round((select avg(abs(y - x)) from a), 7) as mean_abs_maf_shift from cells"""),
    "q_mask_ploidy": with_tables("reads samples", f"""{USABLE},\n{COUNTS},\n{TRUTH},\n{CELLS}
select sample_id, pos, round(case when sex = 'male' then g0 / (g0 + g1) else g0 / (g0 + g1 + g2) end, 8) as g0,
       round(case when sex = 'male' then g1 / (g0 + g1) else g1 / (g0 + g1 + g2) end, 8) as g1,
       round(case when sex = 'male' then 0 else g2 / (g0 + g1 + g2) end, 8) as g2 from cells join samples using (sample_id)"""),
    "q_strata": _sql(""",
s as (select round(maf, 7) as m, round(info, 7) as i, round(mean_depth, 7) as d from sites)
select ((m >= 0.1)::int + (m >= 0.2)::int + (m >= 0.3)::int + (m >= 0.4)::int) * 16
     + (coalesce(i >= -0.2, false)::int + coalesce(i >= 0, false)::int + coalesce(i >= 0.2, false)::int) * 4
     + (d >= 1.2)::int + (d >= 1.5)::int + (d >= 2)::int as stratum, count(*) as n_sites from s group by 1""", True),
    "q_no_call_cap": _sql("""
, s as (select sample_id, pos, ln(greatest(round(g0, 7), round(g1, 7), round(g2, 7))) as score from cells),
r as (select *, row_number() over (partition by pos order by score, sample_id) - 1 as k, count(*) over (partition by pos) as n from s),
lim as (select pos, min(score) as cap_score from r where k = floor(0.1 * n) group by 1)
select pos, count(*) filter (where score < least(-0.5, cap_score)) as n_missing, count(*) as n from r join lim using (pos) group by 1"""),
    "q_threshold_scan": _sql(_PRED + """,
th as (select unnest([0.3::double, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as threshold),
rows_in as (select threshold, truth, pred from pred, th where prob >= threshold)""" + _agree("threshold", "rows_in") + """,
o as (select threshold, n_called / (select count(*) from pred where truth >= 0)::double as call_rate, macro_f1, balanced_accuracy from agreed),
p as (select *, round(0.5 * balanced_accuracy + 0.5 * macro_f1 + 0.03 * call_rate, 9) as objective from o where call_rate >= 0.2)
select threshold, round(call_rate, 8) as call_rate, round(macro_f1, 8) as macro_f1, round(balanced_accuracy, 8) as balanced_accuracy,
       round(objective, 8) as objective, row_number() over (order by objective desc, threshold) = 1 as best from p"""),
    "q_f1_bacc": _sql(_PRED + ", rows_in as (select (pos % 10)::int as decile, truth, pred from pred)" + _agree("decile", "rows_in") + """
select decile, n_called, round(macro_f1, 8) as macro_f1, round(balanced_accuracy, 8) as balanced_accuracy from agreed"""),
    "q_hardcall_stats": _sql(""",
r as (select pos, round(g0, 7) as g0, round(g1, 7) as g1, round(g2, 7) as g2 from cells),
c as (select pos, case when greatest(g0, g1, g2) >= 0.6 then case when g0 >= g1 and g0 >= g2 then 0 when g1 >= g2 then 1 else 2 end else -1 end as call from r),
s as (select pos, count(*) filter (where call >= 0) as k, count(*) as n, sum(case when call >= 0 then call else 0 end) / greatest(2.0::double * count(*) filter (where call >= 0), 1) as af,
  count(*) filter (where call = 1) as het from c group by 1)
select round(avg(case when k > 0 then least(af, 1 - af) end), 8) as mean_maf, round(avg(case when k > 0 then het / k::double end), 8) as mean_het_rate,
       round(avg(k / n::double), 8) as mean_call_rate from s"""),
    "q_context_features": with_tables("reads positions", f"""{USABLE},\n{COUNTS},\n{TRUTH},\n{CELLS},\n{SITES},
s as (select chrom, pos, round(maf, 7) as x, row_number() over (partition by chrom order by pos) as k, count(*) over (partition by chrom) as n
      from sites join positions using (pos)),
near as (select a.chrom, a.pos, b.x from s a, unnest([-2, -1, 0, 1, 2]) as t(d) join s b on b.chrom = a.chrom and b.k = least(a.n, greatest(1, a.k + d)))
select chrom, pos, round(avg(x), 6) as local_mean, round(stddev_pop(x), 5) as local_std from near group by all"""),
    "q_masked_cv_grid": _sql(_grid_sql(), True),
}
