"""Queries of recombination rates trained on posteriors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import hmm, ratetraining
from lociweave.plans import domain
from lociweave.plans.domain import with_tables
from lociweave.plans.hmm_queries import _FB, _GRID, _given

WINDOW = 200


def _rates(spark, folder):
    switches = hmm.scanned_switches(*_given(spark, folder), 1, ratetraining.EDGE)
    return ratetraining.rates_of_switches(switches, domain.positions(spark, folder), domain.samples(spark, folder), True, WINDOW)


def q_recombination_training(spark, folder):
    """Rates of all sites, scaled by chromosome and by window as haploid posteriors say."""
    out = _rates(spark, folder)
    return out.select("chrom", "pos", *[F.round(c, 8).alias(c) for c in ("rate_before", "scale", "multiplier", "rate")])


def q_recombination_training_summary(spark, folder):
    """Scale and median rates of each chromosome."""
    out = ratetraining.summary(_rates(spark, folder))
    return out.select("chrom", F.round("scale", 7).alias("scale"), "n_adjusted", *[F.round(c, 8).alias(c) for c in ("median_rate_before", "median_rate_after")])


QUERIES = {f.__name__: f for f in (q_recombination_training, q_recombination_training_summary)}

_TRAINED = f"""near as (select y.chrom, y.pos, least(1 - 1e-6::double, greatest(1e-6::double, 1 - list_dot_product(x.h, y.h))) as s
  from hap x join hap y on x.sample_id = y.sample_id and x.chrom = y.chrom and y.t = x.t + 1),
mid as (select chrom, pos, median(s) as s from near group by all),
ratio as materialized (select chrom, pos, (pos - low) // {WINDOW} as win, -ln(1 - s) / (select median(generation) from samples where generation > 0) / rate as r
  from mid join rated using (chrom, pos) join (select chrom, min(pos) as low from positions group by 1) using (chrom)),
scales as (select chrom, least(4.0::double, greatest(0.25::double, median(r))) as scale from ratio group by 1),
loc as (select chrom, win, least(4.0::double, greatest(0.25::double, median(r))) as local, count(*) as n from ratio group by all having count(*) > 1),
factors as (select chrom, pos, least(4.0::double, greatest(0.25::double, 1 + n / (n + 20.0::double) * (local / scale - 1))) as multiplier
  from ratio join loc using (chrom, win) join scales using (chrom)),
trained as (select chrom, pos, rate as rate_before, coalesce(scale, 1) as scale, coalesce(multiplier, 1) as multiplier, bp is null as is_first,
  case when bp is null then 1e-10 else least(0.25::double, greatest(1e-10::double, rate * coalesce(scale, 1) * coalesce(multiplier, 1))) end as rate
  from rated left join scales using (chrom) left join factors using (chrom, pos))
"""

ORACLE_SQL = {
    "q_recombination_training": with_tables("reads founders positions samples", f"""{_GRID},\n{_FB},\n{_TRAINED}
select chrom, pos, round(rate_before, 8) as rate_before, round(scale, 8) as scale, round(multiplier, 8) as multiplier, round(rate, 8) as rate from trained""").replace("with ", "with recursive ", 1),
    "q_recombination_training_summary": with_tables("reads founders positions samples", f"""{_GRID},\n{_FB},\n{_TRAINED}
select chrom, round(any_value(scale), 7) as scale, count(*) filter (where multiplier <> 1) as n_adjusted, round(median(rate_before), 8) as median_rate_before,
       round(median(rate), 8) as median_rate_after from (select *, count(*) over (partition by chrom) as n from trained) where not is_first or n = 1 group by 1""").replace("with ", "with recursive ", 1),
}
