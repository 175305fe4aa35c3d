"""Queries of mixed models: heritability, traits freed of relatedness, association leaving the variant's own group out."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import mixedmodels as mm
from lociweave.plans import domain
from lociweave.plans.domain import with_tables

#: All of the dosage matrix's components: it has 64 variants.
COMPONENTS = 64


def _genotypes(spark, folder):
    return domain.matrix(spark, folder).select("id", "variant", "dosage", (F.col("variant") % 4).alias("grp"))


def _traits(spark, folder):
    """Two traits of each sample: a sum of some of its dosages with a term of its number, and its family with gaps."""
    s = domain.matrix(spark, folder).groupBy("id").agg(F.sum(F.when(F.col("variant") < 8, F.col("dosage"))).alias("s"), F.max("fam").alias("fam"))
    sum_ = F.col("s") + F.pmod(F.col("id") * 7919, F.lit(101)) / 100.0
    family = F.when(F.col("id") % 9 != 0, F.col("fam").cast("double"))
    each = F.explode(F.array(F.struct(F.lit("sum").alias("trait"), sum_.alias("value")), F.struct(F.lit("family").alias("trait"), family.alias("value"))))
    return s.select("id", each.alias("t")).select("id", "t.trait", "t.value")


def q_heritability(spark, folder):
    """Heritability of both traits, over all variants and leaving each of four groups out."""
    u, s = mm.eigenvectors(mm.standardised(_genotypes(spark, folder), groups=True), COMPONENTS, leave_out=True)
    out = mm.heritability(mm.rotated(u, s, _traits(spark, folder)))
    return out.select("trait", "run", F.round("h2", 4).alias("h2"), F.round("likelihood", 3).alias("likelihood"), F.round("p", 4).alias("p"))


def q_blup(spark, folder):
    """Best linear unbiased predictions of both traits from all variants."""
    traits = _traits(spark, folder)
    u, s = mm.eigenvectors(mm.standardised(_genotypes(spark, folder), groups=True), COMPONENTS)
    parts = mm.rotated(u, s, traits)
    out = mm.corrected(u, parts, mm.heritability(parts), "blup", traits)
    return out.select("trait", "id", F.round("value", 4).alias("blup"))


def q_gwas_loco(spark, folder):
    """Both traits, whitened by all groups of variants but one, against the variants of that group."""
    out = mm.gwas(_genotypes(spark, folder), _traits(spark, folder), COMPONENTS)
    return out.select("variant", "trait", *[F.round(c, 4).alias(c) for c in ("beta", "beta_se", "stat", "neglog_p")], "dof")


def q_gwas_tests(spark, folder):
    """The uncorrected family trait by t, Wald and score tests."""
    z, traits = mm.standardised(_genotypes(spark, folder)), _traits(spark, folder).where("trait = 'family'")
    out = None
    for stat in ("ttest", "wald", "score"):
        one = mm.scaled_association(z, traits, stat).withColumn("test", F.lit(stat))
        out = one if out is None else out.unionByName(one)
    return out.select("test", "variant", *[F.round(c, 6).alias(c) for c in ("beta", "beta_se", "stat")], F.round("neglog_p", 4).alias("neglog_p"), "dof")


QUERIES = {f.__name__: f for f in (q_heritability, q_blup, q_gwas_loco, q_gwas_tests)}

#: -log10 of the two-sided tail of t with dof degrees of freedom, by the finite series for whole numbers of them.
T_TAIL = """-log10(1 - case when dof % 2 = 0
  then sin(th) * list_sum(list_transform(range(dof // 2), lambda j: exp(lgamma(j + 0.5::double) - lgamma(j + 1.0::double) - lgamma(0.5::double)) * pow(cos(th), 2 * j)))
  else 2 / pi() * (th + sin(th) * coalesce(list_sum(list_transform(range((dof - 1) // 2), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1.0::double) - lgamma(j + 1.5::double)) * pow(cos(th), 2 * j + 1))), 0)) end)"""
#: -log10 of twice the upper normal tail at z, by Simpson's rule on [z / sqrt 2, that + 8].
NORMAL_TAIL = """-log10(2 / sqrt(pi()) * list_sum(list_transform(range(0, 4001), lambda i: case when i = 0 or i = 4000 then 1 when i % 2 = 1 then 4 else 2 end
  * exp(-pow(z / sqrt(2.0::double) + i * 0.002::double, 2)))) * 0.002::double / 3)"""
ORACLE_SQL = {
    "q_gwas_tests": with_tables("matrix", f"""g as (select id, variant::int as variant, case when stddev_pop(dosage) over w > 0 then (dosage - avg(dosage) over w) / stddev_pop(dosage) over w else 0 end as z
  from matrix window w as (partition by variant)),
t as (select id, fam, (fam - avg(fam) over ()) / stddev_pop(fam) over () as y from (select distinct id, fam::double as fam from matrix where id % 9 <> 0)),
s as (select variant, count(*) - 1 as dof, sum(z * y) as xy, sum(z * z) as xx, sum(y * y) as yy from g join t using (id) group by 1),
b as (select *, xy / xx as beta, unnest(['ttest', 'wald', 'score']) as test from s),
e as (select *, sqrt(case when test = 'score' then yy else greatest(0, yy - beta * beta * xx) end / (dof * xx)) as se from b),
f as (select *, beta / se as t, atan(abs(beta / se) / sqrt(dof)) as th, abs(beta / se) as z from e)
select test, variant, round(beta, 6) as beta, round(se, 6) as beta_se, round(case when test = 'ttest' then t else t * t end, 6) as stat,
  round(case when test = 'ttest' then {T_TAIL} else {NORMAL_TAIL} end, 4) as neglog_p, dof from f"""),
}
