"""Queries of read filters, draws, variant filters, discovery lists, diagnostics and smoothed tracks, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import diagnostics as diag
from lociweave.operators import evidence as ev
from lociweave.operators import filters
from lociweave.plans import domain
from lociweave.plans.domain import with_tables
from lociweave.plans.evidence_queries import COUNTS, TRUTH, USABLE
from lociweave.plans.posterior_queries import CELLS, cells


def _r(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _flagged(spark, folder):
    """Reads with flag bits and an insert length, made from their fragment and order."""
    r = domain.reads(spark, folder)
    return r.withColumn("flag", F.pmod(F.col("fragment") * 37 + F.col("pos") * 11, F.lit(4096)).cast("int")).withColumn(
        "tlen", (F.pmod(F.col("fragment") * 13, F.lit(1200)) - 600).cast("int")
    )


def q_read_flags(spark, folder):
    """What remains by sample after flags, mapping quality and insert length."""
    out = filters.read_filter(_flagged(spark, folder), 52, 450)
    return out.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("flag").alias("flags"), F.max(F.abs("tlen")).alias("longest"))


def q_base_quality(spark, folder):
    """Base qualities with none given (255) at every seventh fragment and missing at every eleventh."""
    q = F.when(F.col("fragment") % 7 == 0, 255).when(F.col("fragment") % 11 == 0, None).otherwise(F.col("qual"))
    return domain.reads(spark, folder).select(filters.base_quality(q, F.col("mapq")).alias("quality")).groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


def q_subsample(spark, folder):
    """Fragments drawn with a probability that depends on the sample; every fifth sample keeps all."""
    p = F.when(F.col("sample_id") % 5 == 0, None).otherwise(0.2 + 0.15 * (F.col("sample_id") % 5))
    out = filters.subsampled(domain.reads(spark, folder), p, "sample_id", "fragment", seed=3)
    return out.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fragment").alias("n_fragments"))


def q_depth_cap(spark, folder):
    """Depth by sample before and after at most two fragments are kept where that is enough."""
    r = domain.reads(spark, folder).select("sample_id", "fragment", "pos")
    kept = filters.depth_capped(r, 2).groupBy("sample_id").agg(F.countDistinct("fragment").alias("n_kept"), F.countDistinct("pos").alias("n_sites"))
    return r.groupBy("sample_id").agg(F.countDistinct("fragment").alias("n_before")).join(kept, "sample_id")


def q_truth_source(spark, folder):
    """Truth labels by source with array genotypes where they exist."""
    e = ev.truth_labels(ev.evidence_counts(ev.usable(domain.reads(spark, folder)))).select("sample_id", "pos", F.col("truth").alias("read_truth"))
    array = domain.matrix(spark, folder).select(F.col("id").alias("sample_id"), (F.col("variant") * 2 + 1).cast("long").alias("pos"), F.col("genotype").alias("array_truth"))
    out = filters.truth_source(e.join(array, ["sample_id", "pos"], "left"), "auto")
    return out.groupBy("truth", "truth_source").agg(F.count(F.lit(1)).alias("n"))


def q_variant_filter(spark, folder):
    """Variants of the matrix that are called often enough and common enough; genotypes of every ninth cell are missing."""
    m = domain.matrix(spark, folder).withColumn("genotype", F.when((F.col("id") + F.col("variant") * F.col("variant")) % 9 == 0, -1).otherwise(F.col("genotype")))
    return _r(filters.passing_variants(m, m.select("id").distinct().count(), 0.88, 0.3), 9, "call_rate", "maf")


def q_choose_positions(spark, folder):
    """Fifty positions drawn without replacement."""
    return filters.chosen(domain.positions(spark, folder), 50, "pos", seed=1).select("chrom", "pos")


def q_balanced_rows(spark, folder):
    """A thousand truth-labelled cells with genotypes as even as they can be, by class."""
    e = ev.truth_labels(ev.evidence_counts(ev.usable(domain.reads(spark, folder)))).where("truth >= 0")
    return filters.balanced(e, "truth", 1000, "sample_id", "pos", seed=2).select("sample_id", "pos", "truth")


def q_discovery_union(spark, folder):
    """Two discovery lists as one: the first decides where both have a position."""
    p = domain.positions(spark, folder).select("chrom", "pos", "ref", "alt")
    one = p.where("pos % 3 <> 0").withColumn("depth", F.col("pos") * 2)
    two = p.where("pos % 2 = 0").withColumn("depth", F.col("pos") * 5)
    return filters.first_discoveries(one, two)


def q_variant_diagnostics(spark, folder):
    """Quality figures of every site."""
    n = domain.samples(spark, folder).count()
    out = diag.variant_diagnostics(cells(spark, folder), n, 0.45)
    return _r(out, 6, *[c for c in out.columns if c not in ("pos", "n_samples")])


def q_diagnostics_summary(spark, folder):
    """The figures of all sites against thresholds."""
    out = diag.summary(q_variant_diagnostics(spark, folder))
    return _r(out, 5, *[f"{c}_{k}" for c in diag.SUMMARISED for k in ("mean", "median")])


def q_smoothed_track(spark, folder):
    """Mean alternative share along each chromosome, smoothed by distance."""
    e = ev.evidence_counts(ev.usable(domain.reads(spark, folder)))
    share = e.groupBy("pos").agg(F.round(F.avg((F.col("alt_weight") + 0.5) / (F.col("ref_weight") + F.col("alt_weight") + 1)), 9).alias("share"))
    track = domain.positions(spark, folder).select("chrom", "pos").join(share, "pos").withColumn("generation", F.lit(20.0))
    return _r(filters.smoothed_track(track, "share", "chrom", 0.005), 7, "smoothed")


QUERIES = {f.__name__: f for f in (
    q_read_flags, q_base_quality, q_subsample, q_depth_cap, q_truth_source, q_variant_filter, q_choose_positions, q_balanced_rows, q_discovery_union,
    q_variant_diagnostics, q_diagnostics_summary, q_smoothed_track,
)}


def _draw(seed, *parts):
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)}, '{seed}')), 1, 8))::bigint / 4294967296.0::double"


_DS = "({0}1 + 2 * {0}2)"
_MAX, _ENT = "greatest(g0, g1, g2)", " + ".join(f"-greatest(1e-12::double, g{g}) * ln(greatest(1e-12::double, g{g}))" for g in range(3))
_DIAG = f"""site as (
  select pos, count(*) as n, avg(g1 + 2 * g2) / 2 as af, avg(greatest(0.0::double, g1 + 4 * g2 - pow(g1 + 2 * g2, 2))) as var,
    count(*) filter (where {_MAX} >= 0.45) / (select count(*) from samples)::double as calling_rate,
    avg(g1) as het_rate, greatest(avg(g0), avg(g2)) as hom_rate,
    count(*) filter (where {_MAX} >= 0.45 and g1 > g0 and g1 >= g2) / (select count(*) from samples)::double as hard_het_rate,
    greatest(count(*) filter (where {_MAX} >= 0.45 and g0 >= g1 and g0 >= g2), count(*) filter (where {_MAX} >= 0.45 and g2 > g0 and g2 > g1))
      / (select count(*) from samples)::double as hard_hom_rate,
    avg(({_ENT}) / ln(3.0::double)) as mean_entropy, avg({_MAX}) as mean_max_gp, sum(depth) / (select count(*) from samples)::double as mean_depth,
    count(*) filter (where depth > 0) / (select count(*) from samples)::double as support_rate,
    avg(abs(g1 + 2 * g2 - r1 - 2 * r2)) as calibration_abs_dosage_shift, avg(g1) - avg(r1) as calibration_het_rate_shift,
    avg(r1 + 2 * r2) / 2 as raf, sum(g0) as s0, sum(g1) as s1, sum(g2) as s2
  from cells group by pos),
exp_ as (select *, s0 + s1 + s2 as t, least(1 - 1e-12::double, greatest(1e-12::double, af)) as p from site),
hwe as (select *, (1 - p) * (1 - p) * t as e0, 2 * p * (1 - p) * t as e1, p * p * t as e2 from exp_),
diag as materialized (
  select pos, {', '.join(f'round({c}, 6) as {c}' for c in ('calling_rate', 'het_rate', 'hom_rate', 'hard_het_rate', 'hard_hom_rate', 'mean_entropy', 'mean_max_gp', 'mean_depth', 'support_rate', 'calibration_abs_dosage_shift', 'calibration_het_rate_shift'))},
    round(abs(least(af, 1 - af) - least(raf, 1 - raf)), 6) as calibration_abs_maf_shift, round(1 - calling_rate, 6) as missing_rate,
    (select count(*) from samples) as n_samples, round(af, 6) as alt_af, round(least(af, 1 - af), 6) as maf,
    round(case when 2 * af * (1 - af) > 1e-8 then least(1.0::double, greatest(-5.0::double, 1 - var / (2 * af * (1 - af)))) end, 6) as info,
    round(sqrt((pow((s0 - e0) / t, 2) + pow((s1 - e1) / t, 2) + pow((s2 - e2) / t, 2)) / 3), 6) as hwe_deviation,
    round(pow(s0 - e0, 2) / greatest(e0, 1e-12) + pow(s1 - e1, 2) / greatest(e1, 1e-12) + pow(s2 - e2, 2) / greatest(e2, 1e-12), 6) as hwe_chisq
  from hwe)"""
_KINDS = {"high": ">=", "low": "<="}


def _summary():
    counts = ", ".join(
        f"count(*) filter (where {n} {_KINDS[kind]} {at}) as {n}_{name}" for n, (kind, warn, fail) in diag.CHECKS.items() for name, at in (("warn", warn), ("fail", fail))
    )
    means = ", ".join(f"round({f}({n}), 5) as {n}_{name}" for n in diag.SUMMARISED for f, name in (("avg", "mean"), ("median", "median")))
    worst = [f"greatest({', '.join(f'{n}_{k}' for n in diag.CHECKS)}) > 0" for k in ("fail", "warn")]
    return f"""s as (select count(*) as n_variants, {counts}, {means} from diag)
select *, case when n_variants = 0 then 'empty' when {worst[0]} then 'fail' when {worst[1]} then 'warn' else 'ok' end as status from s"""


_FLAGS = "flagged as (select *, ((fragment * 37 + pos * 11) % 4096)::int as flag, ((fragment * 13) % 1200 - 600)::int as tlen from reads)"
_TRUE = f"{USABLE},\n{COUNTS},\n{TRUTH}"
ORACLE_SQL = {
    "q_read_flags": with_tables("reads", f"""{_FLAGS}
select sample_id, count(*) as n, sum(flag)::bigint as flags, max(abs(tlen)) as longest from flagged
where flag & {filters.SKIPPED_FLAGS} = 0 and mapq >= 52 and abs(tlen) <= 450 group by 1"""),
    "q_base_quality": with_tables("reads", """q as (
  select least(case when fragment % 7 = 0 then 30 when fragment % 11 = 0 then 10 else qual end, mapq) as quality from reads)
select quality, count(*) as n from q group by 1"""),
    "q_subsample": with_tables("reads", f"""p as (select *, case when sample_id % 5 <> 0 then 0.2::double + 0.15::double * (sample_id % 5) end as p from reads)
select sample_id, count(*) as n, count(distinct fragment) as n_fragments from p
where p is null or {_draw(3, 'sample_id::varchar', 'fragment::varchar')} <= p group by 1"""),
    "q_truth_source": with_tables("reads matrix", f"""{_TRUE},
arr as (select id as sample_id, (variant * 2 + 1)::bigint as pos, genotype from matrix),
b as (select coalesce(genotype, truth)::int as truth, case when genotype is not null then 'microarray' when truth >= 0 then 'read_evidence' else 'none' end as truth_source
  from labelled left join arr using (sample_id, pos))
select truth, truth_source, count(*) as n from b group by all"""),
    "q_variant_filter": with_tables("matrix", """m as (select id, variant, case when (id + variant * variant) % 9 = 0 then -1 else genotype end as genotype from matrix),
v as (select variant::int as variant, count(*) filter (where genotype >= 0) / (select count(distinct id) from matrix)::double as call_rate,
  avg(genotype) filter (where genotype >= 0) / 2 as af from m group by 1)
select variant, round(call_rate, 9) as call_rate, round(least(af, 1 - af), 9) as maf from v where call_rate >= 0.88 and least(af, 1 - af) >= 0.3 and least(af, 1 - af) <= 0.5"""),
    "q_choose_positions": with_tables("positions", f"""d as (select chrom, pos, {_draw(1, 'pos::varchar')} as d from positions)
select chrom, pos from d order by d, pos limit 50"""),
    "q_balanced_rows": with_tables("reads", f"""{_TRUE},
d as (select sample_id, pos, truth, {_draw(2, 'sample_id::varchar', 'pos::varchar')} as d from labelled where truth >= 0),
k as (select *, row_number() over (partition by truth order by d, sample_id, pos) as k, (select count(distinct truth) from d) as classes from d)
select sample_id, pos, truth from k order by k > 1000 // classes, d, sample_id, pos limit 1000"""),
    "q_discovery_union": with_tables("positions", """u as (
  select chrom, pos, ref, alt, case when pos % 3 <> 0 then pos * 2 else pos * 5 end as depth from positions where pos % 3 <> 0 or pos % 2 = 0)
select * from u"""),
    "q_variant_diagnostics": with_tables("reads samples", f"{_TRUE},\n{CELLS},\n{_DIAG}\nselect * from diag"),
    "q_diagnostics_summary": with_tables("reads samples", f"{_TRUE},\n{CELLS},\n{_DIAG},\n{_summary()}"),
    "q_smoothed_track": with_tables("reads positions", f"""{USABLE},\n{COUNTS},
s as (select pos, round(avg((alt_weight + 0.5) / (ref_weight + alt_weight + 1)), 9) as x from evidence group by 1),
t as materialized (select chrom, pos, x, row_number() over w as k, exp(-20 * (pos - lag(pos) over w) * 0.005::double) as stay,
  exp(-20 * (lead(pos) over w - pos) * 0.005::double) as stay_back from positions join s using (pos) window w as (partition by chrom order by pos)),
ahead(chrom, k, a) as (select chrom, k, x from t where k = 1 union all
  select t.chrom, t.k, stay * a + (1 - stay) * x from ahead join t on t.chrom = ahead.chrom and t.k = ahead.k + 1),
back(chrom, k, b) as (select chrom, k, x from t where stay_back is null union all
  select t.chrom, t.k, stay_back * b + (1 - stay_back) * x from back join t on t.chrom = back.chrom and t.k = back.k - 1)
select chrom, pos, round(least(2.0::double, greatest(0.0::double, (a + b) / 2)), 7) as smoothed from t join ahead using (chrom, k) join back using (chrom, k)""").replace("with ", "with recursive ", 1),
}
