"""Queries of sites, blocks, maps, founders and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.operators import discovery, evidence, sites
from lociweave.plans import domain
from lociweave.plans.domain import with_tables


def _r(df, *names):
    """Rounds doubles, so that the order of sums does not matter."""
    return df.select(*[F.round(c, 8).alias(c) if c in names else c for c in df.columns])


def q_variant_type(spark, folder):
    """Positions with made-up indels on every seventh and eleventh, by type."""
    p = domain.positions(spark, folder)
    alt = F.when(F.col("pos") % 7 == 0, F.concat("ref", "alt")).when(F.col("pos") % 11 == 0, F.lit(".")).otherwise(F.col("alt"))
    ref = F.when(F.col("pos") % 5 == 0, F.concat("alt", "ref")).otherwise(F.col("ref"))
    return p.select("chrom", "pos", sites.variant_type(ref, alt).alias("variant_type"))


def q_positions_normalised(spark, folder):
    return sites.normalised_positions(domain.positions(spark, folder))


def q_positions_range(spark, folder):
    """One chromosome's positions in a range; both predicates reach the scan."""
    p = domain.positions(spark, folder)
    return p.where((F.col("chrom") == "PROMO") & F.col("pos").between(100, 1500))


def q_ploidy(spark, folder):
    return domain.samples(spark, folder).select("sample_id", sites.ploidy(F.col("sex")).cast("int").alias("ploidy"))


def q_blocks(spark, folder):
    return sites.blocks(domain.positions(spark, folder), 50).select("chrom", "pos", "site_index", "block_id")


def q_overlap_blocks(spark, folder):
    return sites.overlapping_blocks(domain.positions(spark, folder), 50, 5, 0.25).select("chrom", "pos", "overlap_block", "is_core")


def q_genomic_chunks(spark, folder):
    """Base-pair tiles of 250."""
    p = domain.positions(spark, folder).withColumn("chunk", F.floor((F.col("pos") - 1) / 250).cast("long"))
    return p.groupBy("chrom", "chunk").agg(F.count(F.lit(1)).alias("n_sites"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def q_recombination(spark, folder):
    out = sites.recombination(domain.positions(spark, folder)).na.fill(0, ["bp", "dcm"])
    return _r(out.select("chrom", "pos", "bp", "dcm", "rate"), "dcm", "rate")


def q_recomb_switch(spark, folder):
    """Switch, stay and off-diagonal probabilities of each generation at each site, for five founders."""
    rate = sites.recombination(domain.positions(spark, folder))
    generations = domain.samples(spark, folder).select("generation").distinct()
    cells = rate.join(F.broadcast(generations)).withColumn("switch", sites.switch_probability(F.col("rate"), F.col("generation")))
    out = cells.select("chrom", "pos", "generation", "switch", (1 - F.col("switch")).alias("stay"), (F.col("switch") / 4).alias("offdiag"))
    return _r(out, "switch", "stay", "offdiag")


def q_transition_summary(spark, folder):
    out = sites.transition_summary(domain.positions(spark, folder), domain.samples(spark, folder), 5)
    return _r(out, *[c for c in out.columns if c not in ("chrom", "pos", "n_samples")])


def q_genetic_map_interp(spark, folder):
    """Every fourth position is a map point; the rest are interpolated, beyond the ends held."""
    p = domain.positions(spark, folder)
    points = p.where("pos % 4 = 0").select("chrom", "pos", (F.col("cm") * F.col("cm") / 10).alias("cm"))
    return _r(sites.interpolated(p.select("chrom", "pos"), points), "cm")


def q_founder_defaults(spark, folder):
    """Every third panel entry is taken away and falls back to 0.5."""
    panel = domain.founders(spark, folder)
    names = panel.select("founder").distinct()
    return sites.with_defaults(domain.positions(spark, folder), panel.where("(pos + founder) % 3 <> 0"), names)


def q_founder_padding(spark, folder):
    out = sites.padded(domain.founders(spark, folder), 8)
    return out.groupBy("founder", "immutable").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("alt_prob"), 8).alias("mean_alt"))


def q_founder_diversity(spark, folder):
    return _r(sites.founder_diversity(domain.founders(spark, folder)), "sd_mean", "sd_median", "sd_min", "range_mean")


def q_hotspot_windows(spark, folder):
    p = domain.positions(spark, folder).withColumn("cm", F.col("cm") * F.col("cm") / 10)
    return _r(sites.hotspot_windows(p, 200), "multiplier")


def _bases(spark, folder):
    """Reads as bases: code 0 is the reference, 1 the next base, 2 the one after; with the site's chromosome."""
    reads = evidence.usable(domain.reads(spark, folder))
    p = domain.positions(spark, folder).select("chrom", "pos", "ref")
    number = F.pmod(F.col("pos") - 1 + F.col("code"), F.lit(4))
    base = F.substring(F.lit(domain.BASES), (number + 1).cast("int"), F.lit(1))
    return reads.join(p, "pos").withColumn("base", base)


def q_snp_discovery(spark, folder):
    out = discovery.snp_candidates(_bases(spark, folder), max_other_fraction=0.4)
    return _r(out, "alt_fraction", "other_fraction")


def q_indel_discovery(spark, folder):
    """Alternative reads on every third site are insertions, others deletions."""
    b = _bases(spark, folder).where("code = 1")
    alt = F.when(F.col("pos") % 3 == 0, F.concat("ref", "base")).otherwise(F.col("ref"))
    ref = F.when(F.col("pos") % 3 == 0, F.col("ref")).otherwise(F.concat("ref", "base"))
    return discovery.indel_candidates(b.select("sample_id", "chrom", "pos", ref.alias("ref"), alt.alias("alt"), "strand"))


QUERIES = {f.__name__: f for f in (
    q_variant_type, q_positions_normalised, q_positions_range, q_ploidy, q_blocks, q_overlap_blocks, q_genomic_chunks, q_recombination,
    q_recomb_switch, q_transition_summary, q_genetic_map_interp, q_founder_defaults, q_founder_padding, q_founder_diversity,
    q_hotspot_windows, q_snp_discovery, q_indel_discovery,
)}

RATE = """rated as (
  select chrom, pos, pos - lag(pos) over w as bp, cm - lag(cm) over w as dcm,
         case when lag(pos) over w is null then 1e-10 else least(0.25, greatest(1e-10, (cm - lag(cm) over w) / 100)) end::double as rate
  from positions window w as (partition by chrom order by pos))"""
SWITCH = "least(1 - 1e-10::double, greatest(1e-10::double, 1 - exp(-generation * rate)))"
USABLE = """usable as (
  select * exclude (qual), least(qual, mapq) as qual from reads where mapq >= 20 and least(qual, mapq) >= 5)"""
BASES_SQL = """bases as (
  select u.*, p.chrom, p.ref, substr('ACGT', ((u.pos - 1 + u.code) % 4 + 1)::int, 1) as base from usable u join positions p using (pos))"""

ORACLE_SQL = {
    "q_variant_type": with_tables("positions", """p as (
  select chrom, pos, case when pos % 5 = 0 then alt || ref else ref end as ref,
         case when pos % 7 = 0 then ref || alt when pos % 11 = 0 then '.' else alt end as alt from positions)
select chrom, pos, case when alt like '%,%' or alt = '.' then 'invalid'
  when length(ref) = 1 and length(alt) = 1 then 'snp'
  when starts_with(alt, ref) and length(alt) > length(ref) then 'insertion'
  when starts_with(ref, alt) and length(ref) > length(alt) then 'deletion' else 'invalid' end as variant_type from p"""),
    "q_positions_normalised": with_tables("positions", """n as (select count(*) from positions)
select *, 'snp' as variant_type, abs(length(alt) - length(ref))::int as indel_length,
       count(*) over (partition by chrom, pos) = 1 as usable from positions"""),
    "q_positions_range": with_tables("positions", "n as (select 1)\nselect * from positions where chrom = 'PROMO' and pos between 100 and 1500"),
    "q_ploidy": with_tables("samples", """n as (select 1)
select sample_id, case when lower(trim(sex)) in ('m', 'male', '1', 'xy') then 1 else 2 end::int as ploidy from samples"""),
    "q_blocks": with_tables("positions", """r as (select chrom, pos, row_number() over (partition by chrom order by pos) - 1 as site_index from positions)
select *, site_index // 50 as block_id from r"""),
    "q_overlap_blocks": with_tables("positions", """r as (select chrom, pos, row_number() over (partition by chrom order by pos) - 1 as k,
  count(*) over (partition by chrom) as n from positions),
b as (select distinct chrom, k // 50 as overlap_block from r)
select r.chrom, pos, overlap_block, k // 50 = overlap_block as is_core from r join b on r.chrom = b.chrom
 and k between overlap_block * 50 - 13 and overlap_block * 50 + 49 + 13"""),
    "q_genomic_chunks": with_tables("positions", """n as (select 1)
select chrom, (pos - 1) // 250 as chunk, count(*) as n_sites, min(pos) as first_pos, max(pos) as last_pos from positions group by all"""),
    "q_recombination": with_tables("positions", f"{RATE}\nselect chrom, pos, coalesce(bp, 0) as bp, round(coalesce(dcm, 0), 8) as dcm, round(rate, 8) as rate from rated"),
    "q_recomb_switch": with_tables("positions samples", f"""{RATE}
select chrom, pos, generation, round(s, 8) as switch, round(1 - s, 8) as stay, round(s / 4, 8) as offdiag from (
  select chrom, pos, generation, {SWITCH} as s from rated, (select distinct generation from samples))"""),
    "q_transition_summary": with_tables("positions samples", f"""{RATE},
c as (select chrom, pos, {SWITCH} as s from rated, samples where bp is not null)
select chrom, pos, count(*) as n_samples, round(avg(s), 8) as switch_mean, round(median(s), 8) as switch_median, round(min(s), 8) as switch_min,
       round(max(s), 8) as switch_max, round(quantile_cont(s, 0.95), 8) as switch_p95, round(avg(1 - s), 8) as stay_mean,
       round(avg(s / 4), 8) as offdiag_mean, round(avg(1 - (1 - s) * (1 - s)), 8) as any_switch_mean from c group by all"""),
    "q_genetic_map_interp": with_tables("positions", """m as (select chrom, pos, cm * cm / 10 as cm from positions where pos % 4 = 0),
ab as (select p.chrom, p.pos, (select max(m.pos) from m where m.chrom = p.chrom and m.pos <= p.pos) as a,
              (select min(m.pos) from m where m.chrom = p.chrom and m.pos >= p.pos) as b from positions p)
select ab.chrom, ab.pos, round(case when a is null then mb.cm when b is null then ma.cm when a = b then ma.cm
       else ma.cm + (ab.pos - a) / (b - a)::double * (mb.cm - ma.cm) end, 8) as cm
from ab left join m ma on ma.chrom = ab.chrom and ma.pos = a left join m mb on mb.chrom = ab.chrom and mb.pos = b"""),
    "q_founder_defaults": with_tables("founders", """n as (select 1)
select pos, founder, case when (pos + founder) % 3 = 0 then 0.5 else alt_prob end as alt_prob from founders"""),
    "q_founder_padding": with_tables("founders", """p as (
  select founder, 1 as immutable, alt_prob from founders
  union all select f, 0, 0.5 from (select distinct pos from founders), unnest([5, 6, 7]) as t(f))
select founder::bigint as founder, immutable, count(*) as n, round(avg(alt_prob), 8) as mean_alt from p group by all"""),
    "q_founder_diversity": with_tables("founders", """e as (select pos, stddev_samp(alt_prob) as sd, max(alt_prob) - min(alt_prob) as r from founders group by 1)
select count(*) as n_positions, round(avg(sd), 8) as sd_mean, round(median(sd), 8) as sd_median, round(min(sd), 8) as sd_min,
       round(avg(r), 8) as range_mean from e"""),
    "q_hotspot_windows": with_tables("positions", f"""{RATE.replace('from positions window', 'from (select chrom, pos, cm * cm / 10 as cm from positions) window')},
e as (select chrom, pos // 200 as win, avg(rate) as rate, count(*) as n from rated where bp is not null group by all),
m as (select chrom, median(rate) as middle from e group by 1)
select chrom, win as window, n, round(least(4.0::double, greatest(0.25::double, 1 + (rate / greatest(middle, 1e-10) - 1) * n / (n + 20.0::double))), 8) as multiplier
from e join m using (chrom)"""),
    "q_snp_discovery": with_tables("reads positions", f"""{USABLE},\n{BASES_SQL},
s as (select chrom, pos, ref, count(*) as depth, count(*) filter (where base = 'A') as a_count, count(*) filter (where base = 'C') as c_count,
  count(*) filter (where base = 'G') as g_count, count(*) filter (where base = 'T') as t_count, count(*) filter (where base = ref) as ref_count,
  count(distinct case when base <> ref then sample_id end) as sample_support from bases group by all),
n as (select chrom, pos, ref, base, count(*) as k, count(*) filter (where strand = '+') as fwd from bases where base <> ref group by all),
b as (select * from (select *, row_number() over (partition by chrom, pos order by k desc, base) as r from n) where r = 1)
select chrom, pos, ref, b.base as alt, depth, ref_count, k as alt_count, depth - ref_count - k as other_count, sample_support,
       fwd as alt_forward_count, k - fwd as alt_reverse_count, a_count, c_count, g_count, t_count,
       round(k / depth::double, 8) as alt_fraction, round((depth - ref_count - k) / depth::double, 8) as other_fraction
from s join b using (chrom, pos, ref)
where depth >= 3 and k >= 2 and sample_support >= 1 and k / depth::double >= 0.05 and (depth - ref_count - k) / depth::double <= 0.4"""),
    "q_indel_discovery": with_tables("reads positions", f"""{USABLE},\n{BASES_SQL},
e as (select sample_id, chrom, pos, strand, case when pos % 3 = 0 then ref else ref || base end as ref,
             case when pos % 3 = 0 then ref || base else ref end as alt from bases where code = 1)
select chrom, pos, ref, alt, count(*) as alt_count, count(distinct sample_id) as sample_support,
       count(*) filter (where strand = '+') as alt_forward_count, count(*) filter (where strand = '-') as alt_reverse_count,
       case when length(alt) > length(ref) then 'insertion' else 'deletion' end as variant_type
from e group by chrom, pos, ref, alt having count(*) >= 2"""),
}
