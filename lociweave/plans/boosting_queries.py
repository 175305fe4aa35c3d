"""Queries of read-aware features and of boosted genotype calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import boosting
from lociweave.operators import evidence as ev
from lociweave.operators import posterior as gp
from lociweave.plans import domain
from lociweave.plans.domain import with_tables
from lociweave.plans.evidence_queries import COUNTS, TRUTH, USABLE
from lociweave.plans.posterior_queries import CELLS, SITES, cells, entropy_sql
from lociweave.sources.scratch import written


def _features(spark, folder, *keep):
    """Features of every cell with the `keep` columns; cells are worked out and written once, sites are sums of what was written."""
    counts = ("ref_count", "alt_count", "other_count")
    rows = written(cells(spark, folder, *counts).select("sample_id", "pos", "depth", "truth", *counts, "gp"))
    rows = rows.withColumn("dosage", gp.dosage(F.col("gp"))).withColumn("pred", gp.argmax(F.col("gp"))).repartition("pos")
    return boosting.read_aware_features(rows, domain.samples(spark, folder).count(), ("sample_id", "pos", *keep))


def q_calibration_features(spark, folder):
    """The 27 read-aware features of every covered cell."""
    return _features(spark, folder).select("sample_id", "pos", *[F.round(f, 6).alias(f) for f in boosting.FEATURES])


def q_boosted_calls(spark, folder):
    """Genotype probabilities of every cell by boosted trees over its features, learned from the truth of four fifths of the samples."""
    rows = written(_features(spark, folder, "truth", "pred")).withColumn("held_out", F.col("sample_id") % 5 == 0)
    model = boosting.fitted(rows.where(~F.col("held_out")), boosting.FEATURES, "truth")
    out = boosting.predicted(rows, model, ("sample_id", "pos", "truth", "pred", "held_out"))
    return out.select("sample_id", "pos", "held_out", "truth", "pred", *[F.round(F.get("gp", F.lit(g)), 6).alias(f"p{g}") for g in range(3)])


QUERIES = {f.__name__: f for f in (q_calibration_features, q_boosted_calls)}

_OWN = {
    "dosage": "g1 + 2 * g2", "depth": "depth", "log_depth": "ln(1 + depth)", "alt_fraction": "(alt_count + 0.5::double) / (total + 1)", "support_mask": "(total > 0)::int",
    "ref_count": "ref_count", "alt_count": "alt_count", "other_count": "other_count", "total_count": "total", "gp0": "g0", "gp1": "g1", "gp2": "g2", "max_prob": "greatest(g0, g1, g2)",
    "margin": "greatest(g0, g1, g2) - (g0 + g1 + g2 - greatest(g0, g1, g2) - least(g0, g1, g2))", "entropy": entropy_sql("g"),
    "posterior_var": "greatest(0, g1 + 4 * g2 - (g1 + 2 * g2) * (g1 + 2 * g2))", "variant_maf": "maf", "variant_info": "coalesce(info, 0)", "variant_hwe_deviation": "hwe_deviation",
    "variant_hwe_chisq": "hwe_chisq", "site_ref_count": "sum(ref_count) over w", "site_alt_count": "sum(alt_count) over w", "site_other_count": "sum(other_count) over w",
    "site_total_count": "sum(total) over w", "site_support_samples": "count(*) filter (where total > 0) over w", "site_support_rate": "count(*) filter (where total > 0) over w / 25.0::double",
    "site_mean_depth": "sum(total) over w / 25.0::double",
}
ORACLE_SQL = {
    "q_calibration_features": with_tables("reads", f"""{USABLE},\n{COUNTS},\n{TRUTH},\n{CELLS},\n{SITES},
x as (select c.*, maf, info, hwe_deviation, hwe_chisq, ref_count, alt_count, other_count, ref_count + alt_count + other_count as total
  from cells c join sites using (pos) join evidence using (sample_id, pos))
select sample_id, pos, {', '.join(f'round(({v})::double, 6) as {k}' for k, v in _OWN.items())} from x window w as (partition by pos)"""),
}
