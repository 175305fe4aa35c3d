"""Queries of no-call thresholds by class and of callability decisions by level."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import calibration as cal
from lociweave.operators import decisions
from lociweave.operators import posterior as gp
from lociweave.plans import posterior_queries as pq
from lociweave.plans.posterior_queries import _ARG, _MAX, _sql, entropy_sql
from lociweave.sources.scratch import never_broadcast, written

#: Bins of a site's MAF, mean entropy and Hardy-Weinberg deviation, thresholds of log confidence and of callability.
CLASS_BINS = {"maf": (0.0, 0.3, 0.4, 0.5), "mean_entropy": (0.0, 0.6, 0.75, 0.85, 1.01), "hwe_deviation": (0.0, 0.02, 0.05, 0.1, float("inf"))}
LOG_THRESHOLDS = [float("-inf"), -0.9, -0.8, -0.7, -0.6, -0.5, -0.4, -0.3, -0.2]
CALL_THRESHOLDS = [round(0.3 + 0.02 * i, 2) for i in range(31)]
RAW_THRESHOLD, LEAST_ROWS = 0.55, 6


def _cells(spark, folder):
    """Cells, worked out from the reads once."""
    return written(pq.cells(spark, folder).select("pos", "depth", "truth", "gp"))


def _classes(c):
    spread = c.groupBy("pos").agg(F.round(F.avg(gp.entropy(F.col("gp"))), 6).alias("mean_entropy"))
    sites = gp.site_statistics(c).select("pos", F.round("maf", 6).alias("maf"), F.round("hwe_deviation", 6).alias("hwe_deviation")).join(never_broadcast(spread), "pos")
    return cal.strata(sites, CLASS_BINS).select("pos", F.col("stratum").alias("class_id"))


def q_no_call_by_class(spark, folder):
    """A no-call threshold of log confidence for each class of sites by MAF, entropy and Hardy-Weinberg deviation."""
    g = F.col("gp")
    c = _cells(spark, folder)
    cells = c.select("pos", "truth", gp.argmax(g).alias("pred"), F.round(gp.call_score(g, "log_max_gp"), 6).alias("score"))
    out = decisions.thresholds_by_class(cells, _classes(c), LOG_THRESHOLDS, max_no_call_rate=0.9)
    digits = ("train_call_rate", "train_f1", "train_balanced_accuracy")
    return out.select(*[F.round(c, 8).alias(c) if c in digits else c for c in out.columns])


def _level_inputs(spark, folder):
    g = F.col("gp")
    # callability grows with confidence and depth, and with the base that is called
    prob = F.round(F.least(F.lit(1.0), gp.confidence(g) * (0.7 + 0.1 * F.least(F.col("depth"), F.lit(4))) + F.when(gp.argmax(g) == 1, -0.03).otherwise(0.0)), 5)
    c = _cells(spark, folder)
    cells = c.select("pos", "truth", gp.argmax(g).alias("pred"), prob.alias("prob"), F.round(gp.confidence(g), 5).alias("conf"))
    sites = _classes(c).select("pos", (F.col("pos") - 1).alias("site_index"), F.col("class_id").alias("stratum"))
    return cells, sites


def q_hierarchical_decisions(spark, folder):
    """Where calls are gated by callability: all sites, strata, windows of 101 sites or single sites, whichever is finest and accepted."""
    cells, sites = _level_inputs(spark, folder)
    out = decisions.by_level(cells, sites, CALL_THRESHOLDS, RAW_THRESHOLD, LEAST_ROWS, rate_delta=(-0.1, 0.1))
    return out.select(*[F.round(c, 7).alias(c) if t == "double" else c for c, t in out.dtypes])


QUERIES = {f.__name__: f for f in (q_no_call_by_class, q_hierarchical_decisions)}


def _agreed(name: str, keys: str, source: str) -> str:
    """A table `name` of keys, macro_f1, balanced_accuracy, n_called from rows (keys, truth, pred)."""
    return f""",
{name}_t as (select {keys}, truth as cls, count(*) as n_true, count(*) filter (where truth = pred) as tp from {source} group by all),
{name}_q as (select {keys}, pred as cls, count(*) as n_pred from {source} group by all),
{name} as (select {keys}, avg(2 * coalesce(tp, 0) / (coalesce(n_true, 0) + coalesce(n_pred, 0))::double) as macro_f1,
  avg(case when n_true > 0 then tp / n_true::double end) as balanced_accuracy, coalesce(sum(n_true), 0)::bigint as n_called
  from {name}_t full join {name}_q using ({keys}, cls) group by all)"""


def _list(values: list[float]) -> str:
    return "[" + ", ".join("'-infinity'::double" if v == float("-inf") else f"{v!r}::double" for v in values) + "]"


_CLASSES = f""",
spread as (select pos, round(avg({entropy_sql('g')}), 6) as e from cells group by 1),
classes as materialized (select pos, ((m >= 0.3)::int + (m >= 0.4)::int) * 16 + ((e >= 0.6)::int + (e >= 0.75)::int + (e >= 0.85)::int) * 4
  + (h >= 0.02)::int + (h >= 0.05)::int + (h >= 0.1)::int as class_id
  from (select pos, round(maf, 6) as m, round(hwe_deviation, 6) as h, e from sites join spread using (pos)))"""
_OBJECTIVE = "round(0.5 * balanced_accuracy + 0.5 * macro_f1 + 0.03 * {0}, 9)"

ORACLE_SQL = {
    "q_no_call_by_class": _sql(f"""{_CLASSES},
x as materialized (select pos, class_id, truth, {_ARG} as pred, round(ln({_MAX}), 6) as score from cells join classes using (pos) where truth >= 0),
everyone as (select class_id, pos, truth, pred, score from x union all select -1, pos, truth, pred, score from x),
th as (select unnest({_list(LOG_THRESHOLDS)}) as threshold),
kept as materialized (select class_id, threshold, truth, pred from everyone, th where score >= threshold)
{_agreed('a', 'class_id, threshold', 'kept')},
n as (select class_id, count(*) as n_train_rows from everyone group by 1),
worst as (select class_id, threshold, max(r) as worst from (
  select class_id, threshold, pos, count(*) filter (where score < threshold) / count(*)::double as r from x, th group by all) group by all),
s as (select a.*, n_train_rows, n_called / n_train_rows::double as rate, {_OBJECTIVE.format('(n_called / n_train_rows::double)')} as objective
  from a join n using (class_id) left join worst using (class_id, threshold)
  where n_called / n_train_rows::double >= 0.05 and (class_id = -1 or coalesce(worst, 0) <= 0.9)),
g as (select coalesce(arg_max(threshold, (objective, -threshold)), '-infinity'::double) as threshold, coalesce(max(objective), '-infinity'::double) as objective from s where class_id = -1),
own as (select * from (select s.*, row_number() over (partition by class_id order by s.objective desc, s.threshold) as k from s, g
  where class_id <> -1 and s.objective > g.objective and n_train_rows >= 16) where k = 1)
select c.class_id, n_variants, coalesce(n.n_train_rows, 0)::bigint as n_train_rows, coalesce(own.threshold, g.threshold) as threshold, coalesce(own.objective, g.objective) as objective,
  round(own.rate, 8) as train_call_rate, round(own.macro_f1, 8) as train_f1, round(own.balanced_accuracy, 8) as train_balanced_accuracy, own.class_id is null as fallback_to_global
from (select class_id, count(*) as n_variants from classes group by 1) c left join n using (class_id) left join own using (class_id), g""", True),
    "q_hierarchical_decisions": _sql(f"""{_CLASSES},
x as materialized (select pos, truth, {_ARG} as pred, round(least(1.0::double, {_MAX} * (0.7 + 0.1 * least(depth, 4)) + case when {_ARG} = 1 then -0.03 else 0.0 end), 5) as prob,
  round({_MAX}, 5) >= {RAW_THRESHOLD} as raw from cells),
grp as materialized (select pos, pos - 1 as site_index, unnest([0, 1, 2, 3]) as level, unnest([0, class_id, (pos - 1) // 101, pos - 1]) as grp from classes),
y as materialized (select level, grp, pos, truth, pred, prob, raw from x join grp using (pos)),
size as (select level, grp, count(*) as n_cells, count(*) filter (where truth >= 0) as n_labeled, count(*) filter (where raw) / count(*)::double as raw_rate from y group by all),
raws as (select level, grp, truth, pred from y where truth >= 0 and raw)
{_agreed('rb', 'level, grp', 'raws')},
th as (select unnest(range(0, {len(CALL_THRESHOLDS)} + 1)) as step, unnest(list_concat([-1.0::double], {_list(CALL_THRESHOLDS)})) as threshold),
kept as materialized (select level, grp, step, truth, pred from y, th where truth >= 0 and prob >= threshold)
{_agreed('ka', 'level, grp, step', 'kept')},
rates as (select level, grp, step, count(*) filter (where prob >= threshold) as k from y, th group by all),
s as (select ka.*, threshold, k / n_cells::double as rate, raw_rate, n_labeled, greatest(0.0, raw_rate - 0.1) as low, greatest(greatest(0.0, raw_rate - 0.1), least(1.0, raw_rate + 0.1)) as high
  from ka join rates using (level, grp, step) join size using (level, grp) join th using (step)),
s2 as (select *, case when step > 0 and rate >= low and rate <= high then {_OBJECTIVE.format('rate')} end as score, {_OBJECTIVE.format('(n_called / n_labeled::double)')} as own_objective from s),
chosen as (select * from (select *, row_number() over (partition by level, grp order by coalesce(score, -1) desc, step) as k from s2) where k = 1),
sitewise as (select level, grp, pos, count(*) filter (where raw) as rc, sum(pred) filter (where raw) as ra, count(*) filter (where raw and pred = 1) as rh,
  count(*) filter (where prob >= threshold) as kc, sum(pred) filter (where prob >= threshold) as ka, count(*) filter (where prob >= threshold and pred = 1) as kh
  from y join chosen using (level, grp) group by all),
pop as (select level, grp, avg(case when rc > 0 then least(ra / (2.0::double * rc), 1 - ra / (2.0::double * rc)) end) as raw_maf, avg(case when rc > 0 then rh / rc::double end) as raw_het,
  avg(case when kc > 0 then least(ka / (2.0::double * kc), 1 - ka / (2.0::double * kc)) end) as maf, avg(case when kc > 0 then kh / kc::double end) as het from sitewise group by all),
dec as (select z.level, z.grp, z.n_labeled, c.threshold, c.step, c.own_objective - raw_objective as gain,
    z.n_labeled >= case when z.level < 2 then {LEAST_ROWS} when z.level = 2 then 8 else 6 end as enough,
    concat_ws(',', case when coalesce(c.rate, 1) > greatest(greatest(0.0, z.raw_rate - 0.1), least(1.0, z.raw_rate + 0.1)) + 1e-6 then 'call_rate_above_bound' end,
      case when coalesce(c.rate, 1) < greatest(0.0, z.raw_rate - 0.1) - 1e-6 then 'call_rate_below_bound' end,
      case when abs(het - raw_het) > 0.12 then 'hardcall_het_shift_guard' end, case when abs(maf - raw_maf) > 0.08 then 'hardcall_maf_shift_guard' end,
      case when own_objective < round(raw_objective + 0.0, 9) then 'no_objective_improvement' end, case when score is null then 'no_threshold' end,
      case when own_objective is null then 'nonfinite_objective' end) as why
  from size z left join chosen c using (level, grp) left join pop using (level, grp)
  left join (select rb.level, rb.grp, {_OBJECTIVE.format('(n_called / n_labeled::double)')} as raw_objective from rb join size using (level, grp)) using (level, grp)),
heard as (select *, case when enough then why else 'insufficient_labels' end as reason from dec where enough or level < 3),
own as (select pos, site_index, max(case when reason = '' then level end) as use_level, arg_max(reason, case when reason is not null then level end) as last_reason from grp left join heard using (level, grp) group by all),
used as (select o.*, h.grp as use_grp, h.threshold as use_threshold, h.gain from own o left join grp g on g.pos = o.pos and g.level = o.use_level left join heard h on h.level = g.level and h.grp = g.grp),
fin as (select pos, count(*) as n, count(*) filter (where truth >= 0) as n_labeled, count(*) filter (where raw) as rc, sum(pred) filter (where raw) as ra, count(*) filter (where raw and pred = 1) as rh,
  count(*) filter (where kept) as kc, sum(pred) filter (where kept) as ka, count(*) filter (where kept and pred = 1) as kh
  from (select x.*, case when use_threshold is null then raw else prob >= use_threshold end as kept from x join used using (pos)) group by 1),
m as (select *, rc / n::double as rr, kc / n::double as kr, abs(case when rc > 0 then least(ra / (2.0::double * rc), 1 - ra / (2.0::double * rc)) end - case when kc > 0 then least(ka / (2.0::double * kc), 1 - ka / (2.0::double * kc)) end) as ms,
  abs(case when rc > 0 then rh / rc::double end - case when kc > 0 then kh / kc::double end) as hs from fin),
w as (select *, case when use_level is null then '' else concat_ws(',', case when kr - rr < -0.1 - 1e-6 then 'per_snp_call_rate_below_bound' end, case when kr - rr > 0.1 + 1e-6 then 'per_snp_call_rate_above_bound' end,
  case when ms > 0.08 then 'per_snp_maf_shift_guard' end, case when hs > 0.12 then 'per_snp_het_shift_guard' end) end as guard from m join used using (pos)),
v as (select *, use_level is not null and guard = '' as ok from w)
select pos, n_labeled, ok as calibration_used,
  case when not ok then 'raw_no_call' when use_level = 0 then 'global' else ['global', 'feature_stratum', 'local_window', 'per_snp'][use_level + 1] || ':' || use_grp end as decision_source,
  case when ok then 'ok' when guard <> '' then guard else coalesce(last_reason, 'not_evaluated') end as fallback_reason,
  case when ok then use_threshold else {RAW_THRESHOLD} end as threshold, round(rr, 7) as call_rate_raw, round(case when ok then kr else rr end, 7) as call_rate_calibrated,
  round(case when ok then kr - rr else 0 end, 7) as call_rate_delta, round(case when ok then gain end, 7) as objective_delta,
  round(case when ok then ms when rc > 0 then 0 end, 7) as maf_shift, round(case when ok then hs when rc > 0 then 0 end, 7) as het_shift from v""", True),
}
