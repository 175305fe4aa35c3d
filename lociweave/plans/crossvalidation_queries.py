"""Queries of cross-validated imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import crossvalidation
from lociweave.operators import evidence as ev
from lociweave.operators import models
from lociweave.plans import domain
from lociweave.plans.domain import with_tables
from lociweave.plans.evidence_queries import TRUTH
from lociweave.plans.hmm_queries import _FB2, _GRID2, _evidence
from lociweave.sources.scratch import written

FOLDS = 2


def q_cv_harness(spark, folder):
    """Each fold's sites as imputed without their reads, against the labels that these reads give."""
    # the folds, the truth and the scores read it
    evidence, positions = written(_evidence(spark, folder)), domain.positions(spark, folder)
    folds = models.folds(positions, FOLDS, F.col("pos") * 7919 % 1009).select("pos", "fold")
    truth = crossvalidation.pseudo_truth(ev.truth_labels(evidence).where("truth >= 0").select("sample_id", "pos", F.col("truth").alias("genotype")))
    out = crossvalidation.harness(evidence, positions, domain.samples(spark, folder), domain.founders(spark, folder), folds, FOLDS, truth)
    return out.select("generation_scale", "fold", "n_truth", F.round("accuracy", 6).alias("accuracy"), F.round("dosage_mse", 6).alias("dosage_mse"), F.round("read_log_likelihood", 2).alias("read_log_likelihood"))


QUERIES = {f.__name__: f for f in (q_cv_harness,)}

#: The scan's tables with a sample for each fold, numbered 10 * sample + fold, without the fold's reads.
_MASKED = """folds as (select pos, ((row_number() over (partition by chrom order by pos * 7919 % 1009, pos) - 1) % 2)::int as fold from positions),
evidence as (select e.* replace (e.sample_id * 10 + k as sample_id) from seen e join folds using (pos), unnest(range(2)) t(k) where fold <> k),
copies as (select s.* replace (s.sample_id * 10 + k as sample_id) from samples s, unnest(range(2)) t(k)),"""
_SCAN = _GRID2.replace("evidence as (", "seen as (", 1).replace("from usable group by 1, 2),", f"from usable group by 1, 2),\n{_MASKED}", 1).replace("from samples s cross join", "from copies s cross join", 1)

ORACLE_SQL = {
    "q_cv_harness": with_tables("reads founders positions samples", f"""{_SCAN},\n{_FB2},
{TRUTH.replace('from evidence', 'from seen')},
predicted as (select fold, sample_id // 10 as sample_id, pos, g0, g1, g2 from gp join folds using (pos) where fold = sample_id % 10),
right_ as (select fold, count(*) as n_truth, avg((truth = case when g0 >= g1 and g0 >= g2 then 0 when g1 >= g2 then 1 else 2 end)::int) as accuracy,
  avg(pow(g1 + 2 * g2 - truth, 2)) as dosage_mse from predicted join labelled using (sample_id, pos) where truth >= 0 group by 1),
share as (select fold, sample_id, pos, least(1 - 1e-6::double, greatest(1e-6::double, (g1 + 2 * g2) / 2)) as a from predicted),
likely as (select fold, sum(ref_count * ln((1 - a) * 0.99 + a * 0.01::double / 3) + alt_count * ln(a * 0.99 + (1 - a) * 0.01::double / 3) + other_count * ln(0.01::double / 3)) as l
  from share join seen using (sample_id, pos) group by 1)
select 1.0::double as generation_scale, fold, coalesce(n_truth, 0) as n_truth, round(accuracy, 6) as accuracy, round(dosage_mse, 6) as dosage_mse, round(l, 2) as read_log_likelihood
from likely left join right_ using (fold)""").replace("with ", "with recursive ", 1),
}
