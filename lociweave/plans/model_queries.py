"""Queries of models, arrays, caches, cross-validation and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import evidence as ev
from lociweave.operators import mixedmodels, models, relatedness, sinks
from lociweave.operators import pedigree as ped
from lociweave.operators.components import components
from lociweave.operators.posterior import argmax, confidence, entropy, margin
from lociweave.plans import domain
from lociweave.plans.domain import with_tables
from lociweave.plans.evidence_queries import COUNTS, USABLE
from lociweave.plans.posterior_queries import cells
from lociweave.plans.relation_queries import EDGES
from lociweave.sources.tables import table
from lociweave.streaming.counts import drained, opened, windowed


def _evidence(spark, folder):
    return ev.evidence_counts(ev.usable(domain.reads(spark, folder)))


def _array(spark, folder):
    """Array genotypes of every vector (most of them no sample) at every second site, from the dosage matrix."""
    m = domain.matrix(spark, folder)
    return m.select(F.col("id").alias("sample_id"), (F.col("variant") * 2 + 1).cast("long").alias("pos"), "genotype")


def q_microarray_inject(spark, folder):
    e = _evidence(spark, folder).select("sample_id", "pos", "ref_count", "alt_count")
    return models.injected(e, _array(spark, folder))


def q_microarray_align(spark, folder):
    return models.aligned(_array(spark, folder), domain.samples(spark, folder))


def q_cache_missing_samples(spark, folder):
    """Samples without any deep cell count as not cached."""
    deep = _evidence(spark, folder).where("depth >= 7")
    return sinks.missing_samples(domain.samples(spark, folder).select("sample_id"), deep)


def q_cv_folds(spark, folder):
    out = models.folds(domain.positions(spark, folder), 5, F.col("pos") * 7919 % 1009)
    return out.select("chrom", "pos", "fold")


def q_cv_summary(spark, folder):
    """Accuracy of calls by fold, summed up by chromosome."""
    f = models.folds(domain.positions(spark, folder), 5, F.col("pos") * 7919 % 1009).select("chrom", "pos", "fold")
    g = cells(spark, folder).where("truth >= 0").select("pos", "truth", argmax(F.col("gp")).alias("pred"), F.round(confidence(F.col("gp")), 7).alias("conf"))
    r = g.join(f, "pos").groupBy("chrom", "fold").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy"), F.avg("conf").alias("confidence"))
    out = models.cv_summary(r, "chrom")
    return out.select("chrom", F.round("mean_accuracy", 8).alias("mean_accuracy"), F.round("mean_confidence", 6).alias("mean_confidence"), "n_runs")


def q_pedigree_components(spark, folder):
    """Families: the undirected components of the pedigree and their sizes."""
    e = ped.edges(domain.pedigree(spark, folder), domain.samples(spark, folder))
    c = components(e.select(F.col("child").alias("a"), F.col("parent").alias("b")))
    all_ = domain.samples(spark, folder).select(F.col("sample_id").alias("node")).join(c, "node", "left")
    return all_.groupBy(F.coalesce("component_id", "node").alias("component_id")).agg(F.count(F.lit(1)).alias("n"))


def q_callability_model(spark, folder):
    """Probability that a call is right, for cells with a truth."""
    g = F.col("gp")
    rows = cells(spark, folder).where("truth >= 0").select(
        "sample_id", "pos", "depth", confidence(g).alias("conf"), margin(g).alias("margin"), entropy(g).alias("entropy"), (argmax(g) == F.col("truth")).cast("int").alias("correct")
    )
    return models.callability(rows, ["depth", "conf", "margin", "entropy"]).select("sample_id", "pos", "correct", F.round("prob", 4).alias("prob"))


def q_isotonic(spark, folder):
    """Chance of a heterozygote calibrated by truth."""
    rows = cells(spark, folder).where("truth >= 0").select("sample_id", "pos", F.get("gp", F.lit(1)).alias("score"), (F.col("truth") == 1).cast("int").alias("het"))
    return models.isotonic(rows, "score", "het")


def q_embedding_pca(spark, folder):
    """First two principal components of all vectors, up to sign."""
    out = mixedmodels.principal_components(domain.matrix(spark, folder).select("id", "variant", "dosage"))
    return out.select("id", *[F.round(F.abs(F.get("pc", F.lit(i))), 5).alias(f"pc{i}") for i in range(2)])


def q_relationship_bands(spark, folder):
    """How many pairs fall into each band of similarity."""
    r = relatedness.correlation_bands(domain.matrix(spark, folder).select("id", "variant", "dosage"), [0.1, 0.2, 0.4], 7)
    return r.select(relatedness.relationship(F.col("r"), 0.1, 0.2, 0.4).alias("band"), F.col("n").alias("n_pairs"))


def q_stream_windows(spark, folder):
    """Daily counts by event type, read as a stream."""
    pattern = f"{folder.rstrip('/')}/events*.parquet"
    stream = opened(spark, pattern, table(spark, folder, "events").schema)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    out = drained(windowed(stream, "ts", "1 day", "2 days", "event_type"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (
    q_microarray_inject, q_microarray_align, q_cache_missing_samples, q_cv_folds, q_cv_summary, q_pedigree_components, q_callability_model,
    q_isotonic, q_embedding_pca, q_relationship_bands, q_stream_windows,
)}

ARRAY = "arr as (select id as sample_id, (variant * 2 + 1)::bigint as pos, genotype from matrix)"
FOLDS = "folds as (select chrom, pos, ((row_number() over (partition by chrom order by pos * 7919 % 1009, pos) - 1) % 5)::int as fold from positions)"


def _cells_sql():
    from lociweave.plans.evidence_queries import TRUTH
    from lociweave.plans.posterior_queries import CELLS

    return f"{USABLE},\n{COUNTS},\n{TRUTH},\n{CELLS}"


ORACLE_SQL = {
    "q_microarray_inject": with_tables("reads matrix", f"""{USABLE},\n{COUNTS},\n{ARRAY}
select sample_id, pos, least(65535, coalesce(ref_count, 0) + case genotype when 0 then 20 when 1 then 10 else 0 end)::bigint as ref_count,
       least(65535, coalesce(alt_count, 0) + case genotype when 2 then 20 when 1 then 10 else 0 end)::bigint as alt_count
from evidence full join arr using (sample_id, pos)"""),
    "q_microarray_align": with_tables("samples matrix", f"""{ARRAY},
ids as (select distinct sample_id, true as has_array from arr)
select sample_id, coalesce(generation, (select median(generation) from samples)) as generation, coalesce(has_array, false) as has_array
from samples full join ids using (sample_id)"""),
    "q_cache_missing_samples": with_tables("reads samples", f"""{USABLE},\n{COUNTS}
select sample_id from samples where sample_id not in (select sample_id from evidence where depth >= 7)"""),
    "q_cv_folds": with_tables("positions", f"{FOLDS}\nselect * from folds"),
    "q_cv_summary": with_tables("reads positions", f"""{_cells_sql()},\n{FOLDS},
r as (select chrom, fold, avg((truth = case when g0 >= g1 and g0 >= g2 then 0 when g1 >= g2 then 1 else 2 end)::int) as a, avg(round(greatest(g0, g1, g2), 7)) as c
  from cells join folds using (pos) where truth >= 0 group by all)
select chrom, round(avg(a), 8) as mean_accuracy, round(avg(c), 6) as mean_confidence, count(*) as n_runs from r group by 1"""),
    "q_pedigree_components": with_tables("samples pedigree", f"""{EDGES},
both_ways as (select child as a, parent as b from edges union all select parent, child from edges),
reach(node, seen) as (select sample_id, sample_id from samples union select r.node, b from reach r join both_ways on a = r.seen),
roots as (select node, min(seen) as component_id from reach group by 1)
select component_id, count(*) as n from roots group by 1""").replace("with ", "with recursive ", 1),
    "q_relationship_bands": with_tables("matrix", """u as (
  select id, variant, c / sqrt(greatest(sum(c * c) over (partition by id), 1e-24)) as u
  from (select id, variant, dosage - avg(dosage) over (partition by id) as c from matrix)),
sim as (select round(sum(x.u * y.u), 7) as r from u x join u y on x.variant = y.variant and x.id < y.id group by x.id, y.id)
select case when r >= 0.4 then 'same' when r >= 0.2 then 'first_degree' when r >= 0.1 then 'inconclusive' else 'unrelated' end as band, count(*) as n_pairs from sim group by 1"""),
    "q_stream_windows": """select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""",
}
