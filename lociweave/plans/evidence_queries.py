"""Queries of evidence, truth labels and fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import evidence as ev
from lociweave.plans import domain
from lociweave.plans.domain import with_tables

USABLE = """usable as (
  select * exclude (qual), least(qual, mapq) as qual from reads where mapq >= 20 and least(qual, mapq) >= 5)"""
COUNTS = """evidence as (
  select sample_id, pos, least(count(*), 65535)::bigint as depth,
         least(count(*) filter (where code = 0), 65535)::bigint as ref_count,
         least(count(*) filter (where code = 1), 65535)::bigint as alt_count,
         least(count(*) filter (where code = 2), 65535)::bigint as other_count,
         round(sum(case when code = 0 then 1 - pow(10, -qual / 10.0::double) else 0 end), 6) as ref_weight,
         round(sum(case when code = 1 then 1 - pow(10, -qual / 10.0::double) else 0 end), 6) as alt_weight,
         round(sum(case when code = 2 then 1 - pow(10, -qual / 10.0::double) else 0 end), 6) as other_weight
  from usable group by 1, 2)"""
TRUTH = """labelled as (
  select *, case
    when clear and alt_count >= 3 and alt_share >= 0.95 then 2
    when clear and both_n >= 4 and ref_count >= 2 and alt_count >= 2 and alt_share between 0.25 and 0.75 then 1
    when clear and ref_count >= 3 and ref_share >= 0.95 then 0 else -1 end as truth
  from (select *, both_n >= 3 and case when depth_n > 0 then other_count / depth_n::double else 0 end <= 0.05 as clear,
               case when both_n > 0 then alt_count / both_n::double else 0 end as alt_share,
               case when both_n > 0 then ref_count / both_n::double else 0 end as ref_share
        from (select *, ref_count + alt_count as both_n, ref_count + alt_count + other_count as depth_n from evidence)))"""
BEST = """best as (
  select * exclude (k) from (
    select *, row_number() over (partition by sample_id, fragment, pos order by qual desc, ord, code) as k from usable) where k = 1)"""


def _usable(spark, folder):
    return ev.usable(domain.reads(spark, folder))


def q_read_filter(spark, folder):
    """Reads by strand and code before and after the quality filters."""
    all_ = domain.reads(spark, folder).groupBy("strand", "code").agg(F.count(F.lit(1)).alias("n_reads"))
    kept = _usable(spark, folder).groupBy("strand", "code").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("qual").alias("sum_qual"))
    return all_.join(kept, ["strand", "code"], "left")


def q_evidence_counts(spark, folder):
    return ev.evidence_counts(_usable(spark, folder))


def q_truth_labels(spark, folder):
    out = ev.truth_labels(ev.evidence_counts(_usable(spark, folder)))
    return out.select("sample_id", "pos", "depth", "ref_count", "alt_count", "other_count", "truth")


def q_overlapping_reads(spark, folder):
    """Reads and fragments that contribute to each sample."""
    return _usable(spark, folder).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_reads"), F.countDistinct("fragment").alias("n_fragments"), F.countDistinct("pos").alias("n_sites")
    )


def q_fragment_compress(spark, folder):
    return ev.compressed(_usable(spark, folder)).select("sample_id", "fragment", "pos", "code", "qual")


def q_fragment_center(spark, folder):
    return ev.centres(ev.compressed(_usable(spark, folder)))


def q_fragment_merge(spark, folder):
    out = ev.merged_fragments(_usable(spark, folder))
    return out.groupBy("sample_id", "fragment", "mate_pair", "flush").agg(
        F.count(F.lit(1)).alias("n_obs"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )


def q_dense_from_fragments(spark, folder):
    """Evidence rebuilt from compressed fragments."""
    return ev.evidence_counts(ev.compressed(_usable(spark, folder)))


def q_fragment_holdout(spark, folder):
    fragments = _usable(spark, folder).select("sample_id", "fragment").distinct()
    return ev.held_out(fragments).groupBy("sample_id").agg(
        F.count_if("is_held").alias("n_held"), F.count_if(~F.col("is_held")).alias("n_kept")
    )


def q_site_alt_fraction(spark, folder):
    out = ev.site_alt_fraction(ev.evidence_counts(_usable(spark, folder)))
    return out.select("pos", F.round("alt_fraction", 9).alias("alt_fraction"))


QUERIES = {f.__name__: f for f in (
    q_read_filter, q_evidence_counts, q_truth_labels, q_overlapping_reads, q_fragment_compress, q_fragment_center,
    q_fragment_merge, q_dense_from_fragments, q_fragment_holdout, q_site_alt_fraction,
)}

ORACLE_SQL = {
    "q_read_filter": with_tables("reads", f"""{USABLE}
select a.strand, a.code, a.n_reads, b.n_kept, b.sum_qual from
  (select strand, code, count(*) as n_reads from reads group by all) a left join
  (select strand, code, count(*) as n_kept, sum(qual)::bigint as sum_qual from usable group by all) b using (strand, code)"""),
    "q_evidence_counts": with_tables("reads", f"{USABLE},\n{COUNTS}\nselect * from evidence"),
    "q_truth_labels": with_tables("reads", f"""{USABLE},\n{COUNTS},\n{TRUTH}
select sample_id, pos, depth, ref_count, alt_count, other_count, truth from labelled"""),
    "q_overlapping_reads": with_tables("reads", f"""{USABLE}
select sample_id, count(*) as n_reads, count(distinct fragment) as n_fragments, count(distinct pos) as n_sites from usable group by 1"""),
    "q_fragment_compress": with_tables("reads", f"{USABLE},\n{BEST}\nselect sample_id, fragment, pos, code, qual from best"),
    "q_fragment_center": with_tables("reads", f"""{USABLE},\n{BEST},
m as (select sample_id, fragment, avg(pos) as mean_pos, count(*) as n_obs from best group by all)
select sample_id, fragment, n_obs, pos as center from (
  select b.sample_id, b.fragment, n_obs, b.pos,
         row_number() over (partition by b.sample_id, b.fragment order by abs(b.pos - mean_pos), b.pos) as k
  from best b join m using (sample_id, fragment)) where k = 1"""),
    "q_fragment_merge": with_tables("reads", f"""{USABLE},
r as (select *, row_number() over (partition by sample_id, fragment order by pos, ord) as k from usable)
select sample_id, fragment, ceil(k / 2.0)::int as mate_pair, ((k - 1) // 4)::int as flush, count(*) as n_obs,
       min(pos) as first_pos, max(pos) as last_pos from r group by all"""),
    "q_dense_from_fragments": with_tables("reads", f"{USABLE},\n{BEST},\n{COUNTS.replace('from usable', 'from best')}\nselect * from evidence"),
    "q_fragment_holdout": with_tables("reads", f"""{USABLE},
f as (select distinct sample_id, fragment, (fragment * 7919 + sample_id) % 5 = 0 as held from usable),
g as (select *, case when not bool_or(held) over w and fragment = min(fragment) over w then true
                     when bool_and(held) over w and fragment = max(fragment) over w then false else held end as is_held
      from f window w as (partition by sample_id))
select sample_id, count(*) filter (where is_held) as n_held, count(*) filter (where not is_held) as n_kept from g group by 1"""),
    "q_site_alt_fraction": with_tables("reads", f"""{USABLE},\n{COUNTS}
select pos, round(case when sum(alt_count + ref_count) > 0 then (sum(alt_count) + 0.5::double) / (sum(alt_count + ref_count) + 1)
                       else 0.5 end, 9) as alt_fraction from evidence group by 1"""),
}
