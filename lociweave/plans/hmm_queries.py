"""Queries of emissions, fragments and the founder-mosaic HMM."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import evidence as ev
from lociweave.operators import founders, hmm, sites
from lociweave.plans import domain
from lociweave.plans.domain import with_tables
from lociweave.plans.evidence_queries import BEST, COUNTS, USABLE
from lociweave.plans.site_queries import RATE
from lociweave.sources.scratch import written


def _evidence(spark, folder):
    return ev.evidence_counts(ev.usable(domain.reads(spark, folder)))


def _fragments(spark, folder):
    return ev.compressed(ev.usable(domain.reads(spark, folder)))


def _r(df, digits, *names):
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


def q_emission_haploid(spark, folder):
    return _r(hmm.haploid_emissions(_evidence(spark, folder), domain.founders(spark, folder)), 7, "log_emission")


def q_emission_diploid(spark, folder):
    return _r(hmm.diploid_emissions(_evidence(spark, folder), domain.founders(spark, folder)), 7, "log_emission")


def q_fragment_likelihood(spark, folder):
    return _r(hmm.fragment_likelihoods(_fragments(spark, folder), domain.founders(spark, folder)), 7, "log_likelihood", "scaled")


def _coupled(spark, folder, mode):
    f = _fragments(spark, folder)
    panel = domain.founders(spark, folder)
    return _r(hmm.coupled_evidence(_evidence(spark, folder), panel, hmm.fragment_likelihoods(f, panel), ev.centres(f), mode), 6, "log_emission")


def q_coupling_replace(spark, folder):
    return _coupled(spark, folder, "replace")


def q_coupling_augment(spark, folder):
    return _coupled(spark, folder, "augment")


def _given(spark, folder):
    return _evidence(spark, folder), domain.positions(spark, folder), domain.samples(spark, folder), domain.founders(spark, folder)


def _posteriors(spark, folder, ploidy, *wanted):
    return hmm.posteriors(*_given(spark, folder), ploidy, wanted=wanted)


def q_gamma_haploid(spark, folder):
    """Founder posteriors of a haploid forward-backward at every site of every sample."""
    out = _posteriors(spark, folder, 1, "hap")
    return out.select("sample_id", "chrom", "pos", *[F.round(F.get("hap", F.lit(k)), 6).alias(f"h{k}") for k in range(5)])


def q_fb_diploid(spark, folder):
    out = _posteriors(spark, folder, 2, "gp", "dosage")
    return out.select("sample_id", "chrom", "pos", F.round("dosage", 6).alias("dosage"), *[F.round(F.get("gp", F.lit(g)), 6).alias(f"g{g}") for g in range(3)])


def _fb_coupled(spark, folder, mode):
    out = hmm.posteriors(*_given(spark, folder), 2, fragments=_fragments(spark, folder), mode=mode, wanted=("gp", "dosage"))
    return out.select("sample_id", "chrom", "pos", F.round("dosage", 6).alias("dosage"), *[F.round(F.get("gp", F.lit(g)), 6).alias(f"g{g}") for g in range(3)])


def q_fb_coupled(spark, folder):
    """Diploid posteriors in which whole fragments take the place of the cells at their centres."""
    return _fb_coupled(spark, folder, "replace")


def q_fb_coupled_augment(spark, folder):
    """Diploid posteriors in which whole fragments count beside the cells at their centres."""
    return _fb_coupled(spark, folder, "augment")


def q_read_log_likelihood(spark, folder):
    """Read log-likelihood of every sample under its diploid posteriors."""
    out = hmm.scanned_read_log_likelihoods(*_given(spark, folder))
    return out.select("sample_id", F.round("read_log_likelihood", 4).alias("read_log_likelihood"))


def q_fb_polyploid(spark, folder):
    """Triploid posteriors, by site means."""
    out = _posteriors(spark, folder, 3, "dosage")
    return out.groupBy("pos").agg(F.round(F.avg("dosage"), 6).alias("mean_dosage"), F.count(F.lit(1)).alias("n"))


def q_ploidy_groups(spark, folder):
    """Males as haploids beside diploid females."""
    s = domain.samples(spark, folder).withColumn("ploidy", sites.ploidy(F.col("sex")))
    out = hmm.by_ploidy(_evidence(spark, folder), domain.positions(spark, folder), s, domain.founders(spark, folder))
    return out.groupBy("sample_id", "ploidy").agg(F.round(F.avg("dosage"), 6).alias("mean_dosage"), F.count(F.lit(1)).alias("n_sites"))


def q_mstep_founders(spark, folder):
    """Founder statistics with shares from single-site emissions."""
    e = hmm.haploid_emissions(_evidence(spark, folder), domain.founders(spark, folder))
    total = e.groupBy("sample_id", "pos").agg(F.sum(F.exp("log_emission")).alias("z"), F.array_sort(F.collect_list(F.struct("founder", "log_emission"))).alias("l"))
    haps = total.select("sample_id", "pos", F.transform("l", lambda x: F.exp(x["log_emission"]) / F.col("z")).alias("hap"))
    return _r(hmm.m_step(haps, hmm.alt_fractions(_evidence(spark, folder))), 7, "numerator", "denominator")


def q_harden_founders(spark, folder):
    p = domain.founders(spark, folder)
    proposed = p.select("pos", "founder", F.round((F.col("alt_prob") + F.pmod(F.col("pos") * 7 + F.col("founder"), F.lit(11)) / 11.0) / 2, 9).alias("alt_prob"), (F.col("founder") == 0).cast("int").alias("immutable"))
    return hmm.hardened(proposed, p)


def q_em_founders(spark, folder):
    """Two rounds of EM over the five given and two mutable founders."""
    panel = sites.padded(domain.founders(spark, folder), 7)
    start = panel.withColumn("alt_prob", F.when(F.col("immutable") == 0, 0.3 + 0.4 * (F.col("founder") - 5)).otherwise(F.col("alt_prob")))
    out, _ = founders.learn_founders(_evidence(spark, folder), domain.positions(spark, folder), domain.samples(spark, folder), start, rounds=2)
    return _r(out, 6, "alt_prob")


def q_founder_start(spark, folder):
    """Where EM starts: the five given founders, and two more drawn from the sites' alternative fractions, with noise."""
    panel = sites.padded(domain.founders(spark, folder), 7)
    out = founders.initial_founders(panel, ev.site_alt_fraction(_evidence(spark, folder)), seed=7, jitter=0.02)
    return _r(out, 7, "alt_prob")


def q_multistart(spark, folder):
    """Three starts of EM over two mutable founders beside the given five, scanned together: their scores and the best one."""
    panel = sites.padded(domain.founders(spark, folder), 7)
    _, scores = founders.multistart(_evidence(spark, folder), domain.positions(spark, folder), domain.samples(spark, folder), panel, starts=3, seed=7, rounds=2)
    return _r(scores, 4, "read_log_likelihood", "founder_delta")


def q_pair_counts(spark, folder):
    return _r(hmm.scanned_pair_counts(*_given(spark, folder)), 4, "n")


def q_xi(spark, folder):
    """Summed posteriors of founder pairs at neighbouring sites."""
    out = hmm.haploid_pair_posteriors(_evidence(spark, folder), domain.positions(spark, folder), domain.samples(spark, folder), domain.founders(spark, folder))
    return _r(out, 6, "n")


def q_fb_factorised(spark, folder):
    """Diploid posteriors whose moves follow a rank-two shape fitted to pair counts."""
    reads, *rest = _given(spark, folder)
    given = written(reads), *rest
    shape = hmm.factorised_transitions(hmm.scanned_pair_counts(*given), 5)
    out = hmm.posteriors(*given, 2, shape=shape, wanted=("dosage",))
    return out.select("sample_id", "chrom", "pos", F.round("dosage", 6).alias("dosage"))


QUERIES = {f.__name__: f for f in (
    q_emission_haploid, q_emission_diploid, q_fragment_likelihood, q_coupling_replace, q_coupling_augment, q_gamma_haploid, q_fb_diploid,
    q_fb_coupled, q_fb_coupled_augment, q_read_log_likelihood, q_founder_start, q_multistart,
    q_fb_polyploid, q_ploidy_groups, q_mstep_founders, q_harden_founders, q_em_founders, q_pair_counts, q_xi, q_fb_factorised,
)}


def _log_e(q):
    return (f"(alt_weight * ln(least(1.0, greatest(1e-5, {q} * 0.999 + (1 - {q}) * (0.001 / 3)))) "
            f"+ ref_weight * ln(least(1.0, greatest(1e-5, (1 - {q}) * 0.999 + {q} * (0.001 / 3)))) + other_weight * ln(0.001::double / 3))")


EMIT = f"emit as materialized (select e.sample_id, e.pos, f.founder, {_log_e('f.alt_prob')} as l from evidence e join founders f using (pos))"
FRAG = f"""{BEST},
fl as (select b.sample_id, b.fragment, f.founder, sum(ln(case code
   when 1 then least(1.0, greatest(1e-5, f.alt_prob * (1 - er) + (1 - f.alt_prob) * er / 3))
   when 0 then least(1.0, greatest(1e-5, (1 - f.alt_prob) * (1 - er) + f.alt_prob * er / 3))
   else least(1.0, greatest(1e-5, er / 3)) end)) as l
  from (select *, pow(10, -qual / 10.0::double) as er from best) b join founders f using (pos) group by all),
frag as materialized (select *, exp(greatest(l - max(l) over (partition by sample_id, fragment), -ln(1000.0::double))) as scaled from fl)"""
CENTER = """m as (select sample_id, fragment, avg(pos) as mean_pos from best group by all),
center as (select sample_id, fragment, pos as center from (
  select b.sample_id, b.fragment, b.pos, row_number() over (partition by b.sample_id, b.fragment order by abs(b.pos - mean_pos), b.pos) as k
  from best b join m using (sample_id, fragment)) where k = 1),
whole as (select f.sample_id, center as pos, founder, sum(ln(scaled)) as w from frag f join center using (sample_id, fragment) group by all)"""


def _coupling(value):
    return with_tables("reads founders", f"""{USABLE},\n{COUNTS},\n{EMIT},\n{FRAG},\n{CENTER},
v as (select e.sample_id, e.pos, e.founder, {value} as v from emit e left join whole w using (sample_id, pos, founder))
select sample_id, pos, founder, round(greatest(v - max(v) over (partition by sample_id, pos), -ln(1e10::double)), 6) as log_emission from v""")


_GRID = f"""{USABLE},\n{COUNTS},\n{RATE},
cell as (select s.sample_id, r.chrom, r.pos, row_number() over (partition by s.sample_id, r.chrom order by r.pos) as t,
   count(*) over (partition by s.sample_id, r.chrom) as n, least(1 - 1e-10::double, greatest(1e-10::double, 1 - exp(-s.generation * r.rate))) as sw,
   coalesce(ref_weight, 0) as ref_weight, coalesce(alt_weight, 0) as alt_weight, coalesce(other_weight, 0) as other_weight
   from samples s cross join rated r left join evidence e on e.sample_id = s.sample_id and e.pos = r.pos),
ll as (select c.sample_id, c.chrom, c.pos, c.t, c.n, c.sw, list({_log_e('f.alt_prob')} order by f.founder) as l from cell c join founders f using (pos) group by all),
em as materialized (select * exclude (l), list_transform(l, lambda x: exp(x - list_max(l))) as e from ll)"""
_FB = """fwd(sample_id, chrom, t, a) as (
  select sample_id, chrom, t, list_transform(e, lambda x: x / list_sum(e)) from em where t = 1
  union all
  select sample_id, chrom, t, list_transform(v, lambda x: x / list_sum(v)) from (
    select em.sample_id, em.chrom, em.t, list_transform(list_zip(f.a, em.e), lambda z: ((1 - sw - sw / 4) * z[1] + sw / 4 * list_sum(f.a)) * z[2]) as v
    from fwd f join em on em.sample_id = f.sample_id and em.chrom = f.chrom and em.t = f.t + 1)),
bwd(sample_id, chrom, t, b) as (
  select sample_id, chrom, t, list_transform(e, lambda x: 0.2::double) from em where t = n
  union all
  select sample_id, chrom, t, list_transform(v, lambda x: x / list_sum(v)) from (
    select sample_id, chrom, t - 1 as t, list_transform(y, lambda x: (1 - sw - sw / 4) * x + sw / 4 * list_sum(y)) as v from (
      select em.sample_id, em.chrom, em.t, em.sw, list_transform(list_zip(g.b, em.e), lambda z: z[1] * z[2]) as y
      from bwd g join em on em.sample_id = g.sample_id and em.chrom = g.chrom and em.t = g.t where g.t > 1))),
gam as (select em.sample_id, em.chrom, em.pos, em.t, list_transform(list_zip(a, b), lambda z: z[1] * z[2]) as g
  from em join fwd using (sample_id, chrom, t) join bwd using (sample_id, chrom, t)),
hap as materialized (select sample_id, chrom, pos, t, list_transform(g, lambda x: x / list_sum(g)) as h from gam)"""

#: The diploid recursion over lists of 25 ordered founder pairs; number 5 * i + j + 1 is the pair (i, j).
_MOVED = """list_transform(range(25), lambda k: (1 - sw - sw / 4) * (1 - sw - sw / 4) * {x}[k + 1]
    + (1 - sw - sw / 4) * sw / 4 * (list_sum({x}[k // 5 * 5 + 1:k // 5 * 5 + 5]) + list_sum(list_transform(range(5), lambda m: {x}[m * 5 + k % 5 + 1])))
    + sw / 4 * sw / 4 * list_sum({x}))"""
_GRID2 = f"""{USABLE},\n{COUNTS},\n{RATE},
cell as (select s.sample_id, r.chrom, r.pos, row_number() over (partition by s.sample_id, r.chrom order by r.pos) as t,
   count(*) over (partition by s.sample_id, r.chrom) as n, least(1 - 1e-10::double, greatest(1e-10::double, 1 - exp(-s.generation * r.rate))) as sw,
   coalesce(ref_weight, 0) as ref_weight, coalesce(alt_weight, 0) as alt_weight, coalesce(other_weight, 0) as other_weight
   from samples s cross join rated r left join evidence e on e.sample_id = s.sample_id and e.pos = r.pos),
duo as (select f.pos, f.founder * 5 + g.founder as k, (f.alt_prob + g.alt_prob) / 2 as q, f.alt_prob as qa, g.alt_prob as qb from founders f join founders g using (pos)),
ll as (select c.sample_id, c.chrom, c.pos, c.t, c.n, c.sw, list({_log_e('d.q')} order by k) as l, list((1 - qa) * (1 - qb) order by k) as w0,
   list(qa * (1 - qb) + (1 - qa) * qb order by k) as w1, list(qa * qb order by k) as w2 from cell c join duo d using (pos) group by all),
em as materialized (select * exclude (l), list_transform(l, lambda x: exp(x - list_max(l))) as e from ll)"""
_FB2 = f"""fwd(sample_id, chrom, t, a) as (
  select sample_id, chrom, t, list_transform(e, lambda x: x / list_sum(e)) from em where t = 1
  union all
  select sample_id, chrom, t, list_transform(v, lambda x: x / list_sum(v)) from (
    select sample_id, chrom, t, list_transform(list_zip(y, e), lambda z: z[1] * z[2]) as v from (
      select em.sample_id, em.chrom, em.t, em.e, {_MOVED.format(x='f.a')} as y
      from fwd f join em on em.sample_id = f.sample_id and em.chrom = f.chrom and em.t = f.t + 1))),
bwd(sample_id, chrom, t, b) as (
  select sample_id, chrom, t, list_transform(e, lambda x: 0.04::double) from em where t = n
  union all
  select sample_id, chrom, t, list_transform(v, lambda x: x / list_sum(v)) from (
    select sample_id, chrom, t, {_MOVED.format(x='y')} as v from (
      select em.sample_id, em.chrom, em.t - 1 as t, em.sw, list_transform(list_zip(g.b, em.e), lambda z: z[1] * z[2]) as y
      from bwd g join em on em.sample_id = g.sample_id and em.chrom = g.chrom and em.t = g.t where g.t > 1))),
gam as materialized (select em.sample_id, em.chrom, em.pos, w0, w1, w2, list_transform(list_zip(a, b), lambda z: z[1] * z[2]) as g
  from em join fwd using (sample_id, chrom, t) join bwd using (sample_id, chrom, t)),
gp as materialized (select sample_id, chrom, pos, list_dot_product(g, w0) / list_sum(g) as g0, list_dot_product(g, w1) / list_sum(g) as g1,
  list_dot_product(g, w2) / list_sum(g) as g2 from gam)"""

#: What whole fragments say about the founder pairs of a cell, and the emissions with it.
_WHOLE2 = """pieces as materialized (select sample_id, center as pos, list(scaled order by founder) as s from frag join center using (sample_id, fragment) group by sample_id, fragment, center),
touched as materialized (select sample_id, pos, list(w order by k) as w from (
  select sample_id, pos, k, sum(ln(greatest(1e-5::double, (s[k // 5 + 1] + s[k % 5 + 1]) / 2))) as w from pieces, unnest(range(25)) t(k) group by all) group by all)"""


def _coupled_grid(value):
    """_GRID2 with `value` (of l and w, both lists) in the cells that fragments touch."""
    ahead, emission = _GRID2.split("em as materialized")
    held = f"""mixed as (select ll.* exclude (l), case when w is null then l else {value} end as v, w is not null as is_touched from ll left join touched using (sample_id, pos)),
em as materialized (select * exclude (v, is_touched), list_transform(v, lambda x: exp(case when is_touched then greatest(x - list_max(v), -ln(1e10::double)) else x - list_max(v) end)) as e from mixed)"""
    return f"{ahead.rstrip()}\n{FRAG},\n{CENTER},\n{_WHOLE2},\n{held}"


def _fb_coupled_sql(value):
    return with_tables("reads founders positions samples", f"""{_coupled_grid(value)},\n{_FB2}
select sample_id, chrom, pos, round(g1 + 2 * g2, 6) as dosage, round(g0, 6) as g0, round(g1, 6) as g1, round(g2, 6) as g2 from gp""").replace("with ", "with recursive ", 1)


ORACLE_SQL = {
    "q_fb_coupled": _fb_coupled_sql("w"),
    "q_fb_coupled_augment": _fb_coupled_sql("list_transform(list_zip(l, w), lambda z: z[1] + z[2])"),
    "q_read_log_likelihood": with_tables("reads founders positions samples", f"""{_GRID2},\n{_FB2},
share as (select sample_id, pos, least(1 - 1e-6::double, greatest(1e-6::double, (g1 + 2 * g2) / 2)) as a from gp)
select sample_id, round(sum(ref_count * ln((1 - a) * 0.99 + a * 0.01::double / 3) + alt_count * ln(a * 0.99 + (1 - a) * 0.01::double / 3) + other_count * ln(0.01::double / 3)), 4) as read_log_likelihood
from share join evidence using (sample_id, pos) group by 1""").replace("with ", "with recursive ", 1),
    "q_founder_start": with_tables("reads founders", f"""{USABLE},\n{COUNTS},
fraction as (select pos, case when sum(alt_count + ref_count) > 0 then (sum(alt_count) + 0.5::double) / (sum(alt_count + ref_count) + 1) else 0.5 end as af from evidence group by 1),
two as (select pos, founder, least(0.999::double, greatest(0.001::double, coalesce(af, 0.5))) as chance from (select distinct pos from founders) s left join fraction using (pos), unnest([5, 6]) t(founder)),
u as (select *, list_transform(['allele', 'radius', 'angle'], lambda x: (('0x' || substr(md5('7/' || x || '/' || pos || '/' || founder), 1, 8))::bigint + 0.5) / 4294967296.0::double) as u from two)
select pos, founder, round(least(0.9999::double, greatest(0.0001::double, alt_prob)), 7) as alt_prob, 1 as immutable from founders
union all
select pos, founder::bigint, round(least(0.9999::double, greatest(0.0001::double,
  case when u[1] < chance then 0.98 else 0.02 end + 0.02 * sqrt(-2 * ln(u[2])) * cos(2 * pi() * u[3]))), 7), 0 from u"""),
    "q_fb_diploid": with_tables("reads founders positions samples", f"""{_GRID2},\n{_FB2}
select sample_id, chrom, pos, round(g1 + 2 * g2, 6) as dosage, round(g0, 6) as g0, round(g1, 6) as g1, round(g2, 6) as g2 from gp""").replace("with ", "with recursive ", 1),
    "q_xi": with_tables("reads founders positions samples", f"""{_GRID},\n{_FB},
near as materialized (select m.sample_id, m.chrom, m.pos, i, j, f.a[i + 1] * case when i = j then 1 - m.sw else m.sw / 4 end * m.e[j + 1] * b.b[j + 1] as w
  from fwd f join em m on m.sample_id = f.sample_id and m.chrom = f.chrom and m.t = f.t + 1
  join bwd b on b.sample_id = m.sample_id and b.chrom = m.chrom and b.t = m.t, unnest(range(5)) x(i), unnest(range(5)) y(j))
select chrom, pos, i::int as i, j::int as j, round(sum(w / z), 6) as n
from (select *, sum(w) over (partition by sample_id, chrom, pos) as z from near) group by all""").replace("with ", "with recursive ", 1),
    "q_emission_haploid": with_tables("reads founders", f"{USABLE},\n{COUNTS},\n{EMIT}\nselect sample_id, pos, founder, round(l, 7) as log_emission from emit"),
    "q_emission_diploid": with_tables("reads founders", f"""{USABLE},\n{COUNTS},
p as (select a.pos, a.founder as f1, b.founder as f2, (a.alt_prob + b.alt_prob) / 2 as q from founders a join founders b on a.pos = b.pos and a.founder <= b.founder)
select sample_id, e.pos, f1, f2, round({_log_e('q')}, 7) as log_emission from evidence e join p using (pos)"""),
    "q_fragment_likelihood": with_tables("reads founders", f"""{USABLE},\n{FRAG}
select sample_id, fragment, founder, round(l, 7) as log_likelihood, round(scaled, 7) as scaled from frag"""),
    "q_coupling_replace": _coupling("coalesce(w, l)"),
    "q_coupling_augment": _coupling("l + coalesce(w, 0)"),
    "q_gamma_haploid": with_tables("reads founders positions samples", f"""{_GRID},\n{_FB}
select sample_id, chrom, pos, round(h[1], 6) as h0, round(h[2], 6) as h1, round(h[3], 6) as h2, round(h[4], 6) as h3, round(h[5], 6) as h4 from hap""").replace("with ", "with recursive ", 1),
    "q_pair_counts": with_tables("reads founders positions samples", f"""{_GRID},\n{_FB}
select i::int as i, j::int as j, round(sum(x.h[i + 1] * y.h[j + 1]), 4) as n
from hap x join hap y on x.sample_id = y.sample_id and x.chrom = y.chrom and y.t = x.t + 1, unnest(range(5)) a(i), unnest(range(5)) b(j)
group by all""").replace("with ", "with recursive ", 1),
    "q_mstep_founders": with_tables("reads founders", f"""{USABLE},\n{COUNTS},\n{EMIT},
h as (select sample_id, pos, founder, exp(l) / sum(exp(l)) over (partition by sample_id, pos) as h from emit)
select pos, founder, round(sum(h * (alt_weight + 0.5) / (ref_weight + alt_weight + 1)), 7) as numerator, round(sum(h), 7) as denominator
from h join evidence using (sample_id, pos) group by all"""),
    "q_harden_founders": with_tables("founders", """p as (
  select pos, founder, alt_prob as before, round((alt_prob + ((pos * 7 + founder) % 11) / 11.0::double) / 2, 9) as prop from founders),
s as (select pos, count(*) as n, least(1.0::double, greatest(0.0::double, avg(prop))) as m from p where founder > 0 group by 1),
k as (select pos, n, case when m > 0.5::double / n and m < 1 - 0.5::double / n then least(n - 1, greatest(1, round_even(m * n, 0)))
       else least(n, greatest(0, round_even(m * n, 0))) end as n_alt from s),
r as (select *, row_number() over (partition by pos order by round(prop + 0.05 * before, 9) desc, founder desc) as rk from p where founder > 0)
select pos, founder, case when rk <= n_alt then 0.98 else 0.02 end::double as alt_prob, 0 as immutable from r join k using (pos)
union all select pos, founder, prop, 1 from p where founder = 0"""),
}
