"""Queries of posteriors adjusted by pedigree, and of the guard around calibration.

Covered cells count as supported where depth is 2 or more, but for every fifth sample, which stands for the unsequenced.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import calibration as cal
from lociweave.operators import pedigree as ped
from lociweave.operators import posterior as gp
from lociweave.operators import transmission as tr
from lociweave.plans import domain, posterior_queries
from lociweave.plans.domain import with_tables
from lociweave.plans.evidence_queries import COUNTS, TRUTH, USABLE
from lociweave.plans.posterior_queries import CELLS
from lociweave.plans.relation_queries import ANCESTRY, EDGES, KIN

ROUNDS = 2


def _cells(spark, folder):
    sites = domain.positions(spark, folder).select("chrom", "pos")
    supported = (F.col("depth") >= 2) & (F.col("sample_id") % 5 != 4)
    return posterior_queries.cells(spark, folder).join(sites, "pos").select("sample_id", "chrom", "pos", "gp", supported.alias("supported"))


def _kin(spark, folder):
    samples = domain.samples(spark, folder)
    return ped.kinship(ped.ancestry(ped.edges(domain.pedigree(spark, folder), samples), samples))


def _three(df):
    return df.select("sample_id", "pos", *[F.round(F.get("gp", F.lit(g)), 8).alias(f"g{g}") for g in range(3)])


def q_recombination_smoothing(spark, folder):
    """Chances of the alternative smoothed along the chromosome at the generation of each sample."""
    values = _cells(spark, folder).select("sample_id", "chrom", "pos", (gp.dosage(F.col("gp")) / 2).alias("value"))
    out = tr.recombination_smoothed(values, domain.samples(spark, folder).select("sample_id", "generation"))
    return out.select("sample_id", "pos", F.round("smoothed", 9).alias("smoothed"))


def q_kinship_adjusted(spark, folder):
    return _three(tr.kinship_adjusted(_cells(spark, folder), _kin(spark, folder)))


def q_transmission_adjusted(spark, folder):
    """Two rounds of messages between parents and children, then a step towards kin."""
    generations = domain.samples(spark, folder).select("sample_id", "generation")
    return _three(tr.transmission_adjusted(_cells(spark, folder), domain.pedigree(spark, folder), _kin(spark, folder), generations, iterations=ROUNDS))


def q_sanity_guard(spark, folder):
    """Posteriors after a guard that a calibration of sharp site priors does not pass."""
    out = cal.guarded(posterior_queries.cells(spark, folder), max_mean_abs_entropy_shift=0.01)
    return out.select("sample_id", "pos", "status", *[F.round(F.get("gp", F.lit(g)), 8).alias(f"g{g}") for g in range(3)])


QUERIES = {f.__name__: f for f in (q_recombination_smoothing, q_kinship_adjusted, q_transmission_adjusted, q_sanity_guard)}


def _held(x, low, high):
    return f"least({high}::double, greatest({low}::double, {x}))"


def _norm(names, sources):
    held = [_held(s, 1e-8, 1) for s in sources]
    return ", ".join(f"({h}) / ({' + '.join(held)}) as {n}" for n, h in zip(names, held, strict=True))


def _weight(supported="supported"):
    w = f"(0.05 + 0.95 * {_held('(greatest(g0, g1, g2) - 1 / 3.0::double) / (2 / 3.0::double)', 0, 1)})"
    return f"case when {supported} then greatest({w}, 0.75) else least({w}, 0.15) end"


BASE = f"""{USABLE},\n{COUNTS},\n{TRUTH},\n{CELLS},
s0 as materialized (
  select *, {_weight()} as weight, case when bool_or(supported) over (partition by sample_id) then 0.3::double else 1.0::double end as anchor,
    avg((g1 + 2 * g2) / 2) over (partition by pos) as pop
  from (select c.sample_id, chrom, c.pos, g0, g1, g2, depth >= 2 and c.sample_id % 5 <> 4 as supported, (10 + c.sample_id % 5) * 1e-8::double as c
        from cells c join positions p on p.pos = c.pos))"""


def _smooth(i):
    """m{i}: s{i} with x, the chance of the alternative, and its moving averages' mean."""
    return f"""
u{i} as (select *, (g1 + 2 * g2) / 2 as x, c * (pos - min(pos) over t) as u, c * (max(pos) over t - pos) as v from s{i} window t as (partition by sample_id, chrom)),
k{i} as (select *, coalesce(exp(u) - exp(lag(u) over f), 1.0::double) * x as fx, coalesce(exp(v) - exp(lag(v) over b), 1.0::double) * x as bx
  from u{i} window f as (partition by sample_id, chrom order by pos), b as (partition by sample_id, chrom order by pos desc)),
m{i} as materialized (select *, {_held("0.5 * (exp(-u) * sum(fx) over f + exp(-v) * sum(bx) over b)", 0, 1)} as smoothed
  from k{i} window f as (partition by sample_id, chrom order by pos rows unbounded preceding), b as (partition by sample_id, chrom order by pos desc rows unbounded preceding))"""


def _like(other):
    """The likelihoods of a parent's three genotypes."""
    at = [f"(g0 * (1 - {z}) * (1 - {other}) + g1 * ({z} * (1 - {other}) + (1 - {z}) * {other}) + g2 * {z} * {other})" for z in ("1e-5::double", "0.5::double", "(1 - 1e-5::double)")]
    return _norm(("m0", "m1", "m2"), at)


def _round(i):
    """s{i + 1}: s{i} after one round of messages."""
    blend = _held("0.7 * anchor * n / (n + 2.0::double) * (1 - weight)", 0, 0.85)
    mixed = [f"(1 - {blend}) * g{g} + {blend} * m{g}" for g in range(3)]
    return f"""{_smooth(i)},
q{i} as materialized (select sample_id, pos, g0, g1, g2, pop, {_held("0.85 * x + 0.15 * smoothed", 0, 1)} as q from m{i}),
t{i} as materialized (
  select c.sample_id as child, c.pos, c.g0, c.g1, c.g2, father, mother, f.q as fq, m.q as mq,
    {_held("coalesce(f.q, c.pop)", 1e-5, "(1 - 1e-5)")} as a, {_held("coalesce(m.q, c.pop)", 1e-5, "(1 - 1e-5)")} as b
  from q{i} c join pedigree p on p.child = c.sample_id left join q{i} f on f.sample_id = father and f.pos = c.pos
  left join q{i} m on m.sample_id = mother and m.pos = c.pos where f.q is not null or m.q is not null),
e{i} as (select child as id, pos, (1 - a) * (1 - b) as m0, a * (1 - b) + (1 - a) * b as m1, a * b as m2 from t{i}
  union all select father, pos, {_like('b')} from t{i} where fq is not null
  union all select mother, pos, {_like('a')} from t{i} where mq is not null),
i{i} as (select id, pos, n, {_norm(("m0", "m1", "m2"), ("p0", "p1", "p2"))}
  from (select id, pos, count(*) as n, product(m0) as p0, product(m1) as p1, product(m2) as p2 from e{i} group by all)),
s{i + 1} as materialized (
  select sample_id, chrom, pos, supported, c, weight, anchor, pop, case when n is null then g0 else h0 end as g0, case when n is null then g1 else h1 end as g1,
    case when n is null then g2 else h2 end as g2
  from (select *, {_norm(("h0", "h1", "h2"), mixed)} from (select s.*, n, m0, m1, m2 from s{i} s left join i{i} i on i.id = s.sample_id and i.pos = s.pos)))"""


def _kinship(source, strength):
    """kg: source's cells after the step towards kin."""
    soft = [f"exp(-pow(d - {g}, 2) / 0.25)" for g in range(3)]
    mixed = [f"(1 - blend) * g{g} + blend * {x} / ({' + '.join(soft)})" for g, x in enumerate(soft)]
    return f"""
kw as materialized (select *, {_weight()} as w, g1 + 2 * g2 as dosage from {source}),
ks as (select a as sample_id, pos, sum(kinship * w * dosage) / sum(kinship * w) as prior, {_held(f"{strength} * least(1.0::double, sum(kinship * w))", 0, 1)} as blend
  from kin join kw on kw.sample_id = b group by all having sum(kinship * w) > 1e-8),
kd as (select kw.* exclude (w, dosage), coalesce(blend, 0) as blend, {_held("(1 - coalesce(blend, 0)) * dosage + coalesce(blend, 0) * coalesce(prior, dosage)", 0, 2)} as d
  from kw left join ks on ks.sample_id = kw.sample_id and ks.pos = kw.pos),
kg as (select sample_id, pos, {_norm(("k0", "k1", "k2"), mixed)} from kd)"""


def _sql(body):
    return with_tables("reads positions samples pedigree", body).replace("with ", "with recursive ", 1)


_OUT = ", ".join(f"round({{0}}{g}, 8) as g{g}" for g in range(3))
_LAST = [f"(1 - 0.15 * (1 - weight)) * g{g} + 0.15 * (1 - weight) * k{g}" for g in range(3)]
_ENTROPY = posterior_queries.entropy_sql

ORACLE_SQL = {
    "q_recombination_smoothing": _sql(f"{BASE},{_smooth(0)}\nselect sample_id, pos, round(smoothed, 9) as smoothed from m0"),
    "q_kinship_adjusted": _sql(f"{EDGES},\n{ANCESTRY},\n{KIN},\n{BASE},{_kinship('s0', 0.5)}\nselect sample_id, pos, {_OUT.format('k')} from kg"),
    "q_transmission_adjusted": _sql(
        f"{EDGES},\n{ANCESTRY},\n{KIN},\n{BASE},{','.join(_round(i) for i in range(ROUNDS))},{_kinship(f's{ROUNDS}', 0.35)},\n"
        f"z as (select s.sample_id, s.pos, {_norm(('z0', 'z1', 'z2'), _LAST)} from s{ROUNDS} s join kg on kg.sample_id = s.sample_id and kg.pos = s.pos)\n"
        f"select sample_id, pos, {_OUT.format('z')} from z"
    ),
    "q_sanity_guard": with_tables("reads", f"""{USABLE},\n{COUNTS},\n{TRUTH},\n{CELLS},
bad as (select avg(abs({_ENTROPY('g')} - {_ENTROPY('r')})) > 0.01 or avg(abs(g1 + 2 * g2 - r1 - 2 * r2)) > 0.35 or abs(avg(g1) - avg(r1)) > 0.25
  or (select avg(abs(y - x)) from (select avg(r1 + 2 * r2) / 2 as x, avg(g1 + 2 * g2) / 2 as y from cells group by pos)) > 0.2 as bad from cells)
select sample_id, pos, case when bad then 'fallback_to_raw' else 'ok' end as status,
  {', '.join(f'round(case when bad then r{g} else g{g} end, 8) as g{g}' for g in range(3))} from cells, bad"""),
}
