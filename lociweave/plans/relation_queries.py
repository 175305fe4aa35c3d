"""Queries of pedigrees, relatedness, linkage and association."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import evidence as ev
from lociweave.operators import pedigree as ped
from lociweave.operators import relatedness as rel
from lociweave.plans import domain
from lociweave.plans.domain import with_tables
from lociweave.plans.evidence_queries import COUNTS, USABLE
from lociweave.plans.mixed_queries import T_TAIL


def _r(df, digits, *names):
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


def _edges(spark, folder):
    return ped.edges(domain.pedigree(spark, folder), domain.samples(spark, folder))


def _dosages(spark, folder):
    e = ev.evidence_counts(ev.usable(domain.reads(spark, folder)))
    ds = 2 * (F.col("alt_weight") + 0.5) / (F.col("ref_weight") + F.col("alt_weight") + 1)
    return e.select("sample_id", "pos", ds.alias("dosage"), "depth")


def q_pedigree_edges(spark, folder):
    return _edges(spark, folder)


def q_pedigree_order(spark, folder):
    """Steps in which parents come before their children, over the samples' declared parents."""
    return ped.ordered(_edges(spark, folder).select("child", "parent"), domain.samples(spark, folder).select(F.col("sample_id").alias("id")))


def q_ancestry(spark, folder):
    return _r(ped.ancestry(_edges(spark, folder), domain.samples(spark, folder)), 9, "weight")


def q_kinship(spark, folder):
    return _r(ped.kinship(ped.ancestry(_edges(spark, folder), domain.samples(spark, folder))), 9, "kinship")


def q_smooth(spark, folder):
    return _r(ped.smoothed(_dosages(spark, folder), _edges(spark, folder), 0.2), 8, "dosage")


def q_kinship_fallback(spark, folder):
    kin = ped.kinship(ped.ancestry(_edges(spark, folder), domain.samples(spark, folder)))
    p = F.col("dosage") / 2
    top = F.greatest((1 - p) * (1 - p), 2 * p * (1 - p), p * p)
    cells = _dosages(spark, folder).withColumn("weight", ped.evidence_weight(top, F.col("depth") >= 2))
    return _r(ped.kinship_prior(cells, kin), 9, "prior", "strength")


def q_transmission_prior(spark, folder):
    out = ped.transmission_prior(_dosages(spark, folder), domain.pedigree(spark, folder))
    return _r(out, 8, "p0", "p1", "p2")


def q_expected_relationship(spark, folder):
    """Expected relationships of all pairs of samples that share a parent or a family of four."""
    p = domain.pedigree(spark, folder).withColumn("family", F.floor(F.col("child") / 4).cast("long"))
    pairs = rel.paired(p.select("child", "family"), "child", "family", []).select("a", "b")
    near = p.select(F.col("father").alias("a"), F.col("child").alias("b")).where("a < b")
    return ped.expected_relationship(pairs.union(near).distinct(), p)


def _similar(spark, folder, ids=None, least=None):
    return rel.correlations(domain.matrix(spark, folder).select("id", "variant", "dosage"), ids, least)


def _members(spark, folder):
    """The samples that declared edges name: no other pairs are looked at."""
    e = _edges(spark, folder)
    return e.select(F.col("child").alias("id")).union(e.select("parent"))


def q_similarity(spark, folder):
    """Pairs of samples with a correlation of 0.3 or more, and their relationship call."""
    out = _r(_similar(spark, folder, least=0.3 - 1e-6), 7, "r").where("r >= 0.3")
    return out.withColumn("relationship_call", rel.relationship(F.col("r"), 0.32, 0.36, 0.45))


def q_edge_status(spark, folder):
    """Status of declared edges by the correlation of their members' vectors."""
    r = _r(_similar(spark, folder, _members(spark, folder)), 7, "r")
    return ped.edge_status(_edges(spark, folder), r)


def q_sample_status(spark, folder):
    r = _r(_similar(spark, folder, _members(spark, folder)), 7, "r")
    return ped.sample_status(domain.samples(spark, folder), ped.edge_status(_edges(spark, folder), r))


def q_grm(spark, folder):
    out = rel.grm(domain.matrix(spark, folder).select("id", "variant", "dosage"))
    return out.select("a", "b", "n", F.round("relationship", 7).alias("relationship"))


def q_loco_grm(spark, folder):
    """Leave one of four groups of variants out."""
    long = domain.matrix(spark, folder).select("id", "variant", "dosage").withColumn("chrom", F.col("variant") % 4)
    return _r(rel.loco_means(long, "chrom"), 6, "mean_loco")


def q_king(spark, folder):
    return _r(rel.king(domain.matrix(spark, folder).select("id", "variant", "genotype")), 8, "kinship")


def q_cityblock(spark, folder):
    return _r(rel.cityblock(domain.matrix(spark, folder).select("id", "variant", "dosage")), 7, "mean_abs", "sum_abs")


def q_ld_r2(spark, folder):
    out = rel.linkage(domain.matrix(spark, folder).select("id", "variant", "dosage"))
    return _r(out, 7, "cov", "r", "r2", "d", "d2")


def q_gwas_beta_se(spark, folder):
    """Two traits made from sums of a sample's own values."""
    long = domain.matrix(spark, folder)
    s = long.groupBy("id").agg(F.sum(F.when(F.col("variant") < 8, F.col("dosage"))).alias("t0"), F.sum(F.when(F.col("variant") >= 56, F.col("genotype"))).cast("double").alias("t1"))
    traits = s.select("id", F.explode(F.array(F.struct(F.lit("t0").alias("trait"), F.col("t0").alias("value")), F.struct(F.lit("t1").alias("trait"), F.col("t1").alias("value")))).alias("t")).select("id", "t.trait", "t.value")
    return _r(rel.association(long.select("id", "variant", "dosage"), traits), 6, "beta", "beta_se", "stat")


def q_gwas_p(spark, folder):
    """Negative log p-values of one trait, a sample's family number, by the t distribution."""
    long = domain.matrix(spark, folder)
    traits = long.where("variant = 0").select("id", F.lit("fam").alias("trait"), F.col("fam").cast("double").alias("value"))
    out = rel.association(long.select("id", "variant", "dosage"), traits).withColumn("stat", F.round("stat", 6))
    return rel.with_p_values(out).select("variant", "trait", "stat", F.round("neglog_p", 4).alias("neglog_p"))


def q_long_edges(spark, folder):
    """Edges between a vector and the next, by distance in the first two dimensions."""
    m = domain.matrix(spark, folder).where("variant < 2").groupBy("id").agg(F.max(F.when(F.col("variant") == 0, F.col("dosage"))).alias("x"), F.max(F.when(F.col("variant") == 1, F.col("dosage"))).alias("y"))
    n = m.select((F.col("id") - 1).alias("id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    e = m.join(n, "id").select("id", F.round(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")), 7).alias("length"))
    return _r(rel.long_edges(e, 3.0), 7, "threshold")


QUERIES = {f.__name__: f for f in (
    q_pedigree_edges, q_pedigree_order, q_ancestry, q_kinship, q_smooth, q_kinship_fallback, q_transmission_prior, q_expected_relationship, q_similarity,
    q_edge_status, q_sample_status, q_grm, q_loco_grm, q_king, q_cityblock, q_ld_r2, q_gwas_beta_se, q_gwas_p, q_long_edges,
)}

EDGES = """edges as (
  select child, parent, role, parent in (select sample_id from samples) as known from (
    select child, father as parent, 'father' as role from pedigree union all select child, mother, 'mother' from pedigree))"""
ANCESTRY = """paths(id, ancestor, weight, step) as (
  select sample_id, sample_id, 1.0::double, 0 from samples
  union all
  select p.id, e.parent, p.weight * 0.5, p.step + 1 from paths p join edges e on e.child = p.ancestor where e.known and p.step < 20),
ancestry as (select id, ancestor, sum(weight) as weight from paths group by all)"""
KIN = """kin as (
  select x.id as a, y.id as b, 0.5 * sum(x.weight * y.weight) as kinship from ancestry x join ancestry y using (ancestor)
  where x.id <> y.id group by all having 0.5 * sum(x.weight * y.weight) >= 0.01)"""
DS = f"""{USABLE},\n{COUNTS},
dosages as (select sample_id, pos, 2 * (alt_weight + 0.5::double) / (ref_weight + alt_weight + 1) as dosage, depth from evidence)"""
UNIT = """u as (
  select id, variant, c / sqrt(greatest(sum(c * c) over (partition by id), 1e-24)) as u
  from (select id, variant, dosage - avg(dosage) over (partition by id) as c from matrix)),
sim as materialized (select x.id as a, y.id as b, round(sum(x.u * y.u), 7) as r from u x join u y on x.variant = y.variant and x.id < y.id group by all)"""
CALL = "case when r is null then 'not_measured' when r >= 0.88 then 'same' when r >= 0.64 then 'first_degree' when r >= 0.59 then 'inconclusive' else 'unrelated' end"
STATUS = f"""status as (
  select child, parent, role, known, r, {CALL} as relationship_call,
    case when not known then 'no_evidence' when {CALL} in ('unrelated', 'same') then 'removed' when {CALL} = 'first_degree' then 'retained'
         when {CALL} = 'inconclusive' then 'inconclusive' else 'no_evidence' end as edge_qc_status
  from edges left join sim on a = least(child, parent) and b = greatest(child, parent))"""
Z = """z as (select id, variant, variant % 4 as chrom, case when stddev_pop(dosage) over w > 0 then (dosage - avg(dosage) over w) / stddev_pop(dosage) over w else 0 end as z
  from {0} window w as (partition by variant))"""


def _rec(names, body):
    return with_tables(names, body).replace("with ", "with recursive ", 1)


ORACLE_SQL = {
    "q_pedigree_edges": with_tables("samples pedigree", f"{EDGES}\nselect * from edges"),
    "q_pedigree_order": _rec("samples pedigree", f"""{EDGES},
way(id, n) as (select sample_id, 0 from samples union select e.child, n + 1 from way join edges e on e.parent = way.id)
select id, max(n)::int as step, false as on_cycle from way group by 1"""),
    "q_ancestry": _rec("samples pedigree", f"{EDGES},\n{ANCESTRY}\nselect id, ancestor, round(weight, 9) as weight from ancestry"),
    "q_kinship": _rec("samples pedigree", f"{EDGES},\n{ANCESTRY},\n{KIN}\nselect a, b, round(kinship, 9) as kinship from kin"),
    "q_smooth": with_tables("reads samples pedigree", f"""{DS},\n{EDGES},
deg as (select child, count(*) as k from edges where known group by 1),
m as (select e.child, d.pos, sum(d.dosage) as s from edges e join dosages d on d.sample_id = e.parent where known group by all)
select d.sample_id, d.pos, round(0.8 * dosage + 0.2 * coalesce(s, 0) / coalesce(k, 1), 8) as dosage
from dosages d left join deg on deg.child = d.sample_id left join m on m.child = d.sample_id and m.pos = d.pos"""),
    "q_kinship_fallback": _rec("reads samples pedigree", f"""{DS},\n{EDGES},\n{ANCESTRY},\n{KIN},
w0 as (select *, 0.05 + 0.95 * least(1.0::double, greatest(0.0::double, (greatest((1 - dosage / 2) * (1 - dosage / 2), dosage * (1 - dosage / 2), dosage * dosage / 4) - 1 / 3.0::double) / (2 / 3.0::double))) as w from dosages),
w1 as (select *, case when depth >= 2 then greatest(w, 0.75) else least(w, 0.15) end as weight from w0),
k as (select a as sample_id, pos, sum(kinship * weight * dosage) as s, sum(kinship * weight) as w from kin join w1 on w1.sample_id = b group by all)
select sample_id, pos, round(s / w, 9) as prior, round(least(1.0::double, w), 9) as strength from k where w > 1e-8"""),
    "q_transmission_prior": with_tables("reads samples pedigree", f"""{DS},
pop as (select pos, avg(dosage) / 2 as q from dosages group by 1),
c as (select p.child as sample_id, d.pos, least(1 - 1e-5::double, greatest(1e-5::double, coalesce(f.dosage / 2, pop.q))) as a,
             least(1 - 1e-5::double, greatest(1e-5::double, coalesce(m.dosage / 2, pop.q))) as b
  from pedigree p join dosages d on d.sample_id = p.child join pop using (pos)
  left join dosages f on f.sample_id = p.father and f.pos = d.pos left join dosages m on m.sample_id = p.mother and m.pos = d.pos)
select sample_id, pos, round((1 - a) * (1 - b), 8) as p0, round(a * (1 - b) + (1 - a) * b, 8) as p1, round(a * b, 8) as p2 from c"""),
    "q_expected_relationship": with_tables("pedigree", """p as (select *, child // 4 as family from pedigree),
pairs as (select x.child as a, y.child as b from p x join p y on x.family = y.family and x.child < y.child
  union select father, child from p where father < child)
select a, b, case when a in (y.father, y.mother) or b in (x.father, x.mother) then 'parent_offspring'
  when (x.father in (y.father, y.mother))::int + (x.mother in (y.father, y.mother))::int = 2 then 'full_sib'
  when x.father in (y.father, y.mother) or x.mother in (y.father, y.mother) then 'half_sib'
  when x.family = y.family then 'same_family' else 'unrelated' end as expected
from pairs left join p x on x.child = a left join p y on y.child = b"""),
    "q_similarity": with_tables("matrix", f"""{UNIT}
select a, b, r, case when r >= 0.45 then 'same' when r >= 0.36 then 'first_degree' when r >= 0.32 then 'inconclusive' else 'unrelated' end as relationship_call
from sim where r >= 0.3"""),
    "q_edge_status": with_tables("matrix samples pedigree", f"{EDGES},\n{UNIT},\n{STATUS}\nselect * from status"),
    "q_sample_status": with_tables("matrix samples pedigree", f"""{EDGES},\n{UNIT},\n{STATUS},
n as (select child, count(*) filter (where edge_qc_status = 'removed') as k, count(*) filter (where edge_qc_status = 'inconclusive') as i from status group by 1)
select sample_id, coalesce(k, 0) as removed_parent_edges, coalesce(i, 0) as inconclusive_parent_edges,
       case when coalesce(k, 0) > 0 then 'corrected' when coalesce(i, 0) > 0 then 'review' else 'pass' end as pedigree_qc_status
from samples left join n on child = sample_id"""),
    "q_grm": with_tables("matrix", f"""{Z.format('matrix')}
select x.id as a, y.id as b, count(*) as n, round(sum(x.z * y.z) / (count(*) - 1), 7) as relationship from z x join z y on x.variant = y.variant and x.id <= y.id group by all"""),
    "q_loco_grm": with_tables("matrix", f"""{Z.format('matrix')},
g as (select x.id as a, y.id as b, x.chrom, sum(x.z * y.z) as s, count(*) as n from z x join z y on x.variant = y.variant and x.id <= y.id group by all),
l as (select a, chrom, (sum(s) over w - s) / (sum(n) over w - n) as loco from g window w as (partition by a, b))
select a, chrom, round(avg(loco), 6) as mean_loco, count(*) as n_pairs from l group by all"""),
    "q_king": with_tables("matrix", """k as (select x.id as a, y.id as b, count(*) as n, count(*) filter (where abs(x.genotype - y.genotype) = 2) as i0,
  least(count(*) filter (where x.genotype = 1), count(*) filter (where y.genotype = 1)) as h
  from matrix x join matrix y on x.variant = y.variant and x.id < y.id group by all)
select a, b, n, round(case when h > 0 then 0.5 * (1 - i0 / (2.0::double * h)) end, 8) as kinship from k"""),
    "q_cityblock": with_tables("matrix", """n as (select 1)
select x.id as a, y.id as b, round(avg(abs(x.dosage - y.dosage)), 7) as mean_abs, round(sum(abs(x.dosage - y.dosage)), 7) as sum_abs, count(*) as n
from matrix x join matrix y on x.variant = y.variant and x.id < y.id group by all"""),
    "q_ld_r2": with_tables("matrix", """s as (select x.variant::int as a, y.variant::int as b, count(*) as n, avg(x.dosage) as mx, avg(y.dosage) as my, avg(x.dosage * y.dosage) as mxy,
  avg(x.dosage * x.dosage) as mxx, avg(y.dosage * y.dosage) as myy from matrix x join matrix y on x.id = y.id and x.variant < y.variant group by all),
r as (select *, mxy - mx * my as cov, case when mxx - mx * mx > 1e-12 and myy - my * my > 1e-12 then (mxy - mx * my) / sqrt((mxx - mx * mx) * (myy - my * my)) end as r from s),
d as (select *, r * sqrt(mx / 2 * (1 - mx / 2) * (my / 2) * (1 - my / 2)) as d from r)
select a, b, n, round(cov, 7) as cov, round(r, 7) as r, round(r * r, 7) as r2, round(d, 7) as d, round(d * d, 7) as d2 from d"""),
    "q_gwas_beta_se": with_tables("matrix", """t as (
  select id, 't0' as trait, sum(dosage) as value from matrix where variant < 8 group by id
  union all select id, 't1', sum(genotype)::double from matrix where variant >= 56 group by id),
s as (select variant::int as variant, trait, count(*) as n, avg(dosage) as mx, avg(value) as my, avg(dosage * dosage) as mxx, avg(dosage * value) as mxy, avg(value * value) as myy
  from matrix join t using (id) group by all),
b as (select *, n * (mxx - mx * mx) as sxx, n * (mxy - mx * my) as sxy, n * (myy - my * my) as syy from s),
c as (select *, case when sxx > 1e-9 then sxy / sxx end as beta from b),
e as (select *, case when sxx > 1e-9 and n > 2 then sqrt(greatest(0, (syy - beta * sxy) / (n - 2)) / sxx) end as se from c)
select variant, trait, n, round(beta, 6) as beta, round(se, 6) as beta_se, round(case when se > 0 then beta / se end, 6) as stat, n - 2 as dof from e"""),
    "q_gwas_p": with_tables("matrix", """s as (
  select variant::int as variant, count(*) as n, avg(dosage) as mx, avg(fam::double) as my, avg(dosage * dosage) as mxx, avg(dosage * fam) as mxy, avg(fam * fam::double) as myy
  from matrix group by all),
b as (select *, n * (mxx - mx * mx) as sxx, n * (mxy - mx * my) as sxy, n * (myy - my * my) as syy from s),
c as (select variant, n - 2 as dof, round(case when sxx > 1e-9 then sxy / sxx / sqrt(greatest(0, (syy - sxy * sxy / sxx) / (n - 2)) / sxx) end, 6) as stat from b),
t as (select *, atan(abs(stat) / sqrt(dof)) as th from c)
select variant, 'fam' as trait, stat, round(""" + T_TAIL + """, 4) as neglog_p from t"""),
    "q_long_edges": with_tables("matrix", """m as (select id, max(dosage) filter (where variant = 0) as x, max(dosage) filter (where variant = 1) as y from matrix where variant < 2 group by 1),
e as (select a.id, round(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 7) as length from m a join m b on b.id = a.id + 1),
q as (select median(length) as m, quantile_cont(length, 0.95) as q from e),
d as (select median(abs(length - m)) as mad, any_value(m) as m, any_value(q) as q from e, q),
t as (select case when mad <= 1e-8 then q else m + 3 * 1.4826 * mad end as threshold from d)
select id, length, round(threshold, 7) as threshold, length > threshold as is_long from e, t"""),
}
