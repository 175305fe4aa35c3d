"""Queries through files: a genotype set written and read again, and an evidence cache hit in part."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lociweave.operators import evidence as ev
from lociweave.operators import evidencecache, sinks, sites
from lociweave.plans import domain
from lociweave.plans.domain import with_tables
from lociweave.plans.evidence_queries import COUNTS
from lociweave.sources import formats
from lociweave.sources.scratch import shared_folder

BLOCK = 256
_VALUES = "sample_id long, pos long, depth long"


def _fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def q_genotype_set(spark, folder):
    """Genotypes of the matrix by variant, after writing them as a bed, fam and bim file and reading these."""
    cells = domain.matrix(spark, folder)
    ids = cells.select("id").distinct().withColumn("sample_index", (F.row_number().over(Window.orderBy("id")) - 1).cast("long"))
    # samples and variants grow with the table, so joins with their lists are exchanges
    people = ids.select("sample_index", F.lit("f").alias("fid"), F.col("id").cast("string").alias("iid"), F.lit("0").alias("father"), F.lit("0").alias("mother"), F.lit("0").alias("sex"), F.lit("-9").alias("pheno"))
    variants = cells.select(F.col("variant").cast("long").alias("variant_index")).distinct()
    variants = variants.select("variant_index", F.lit("1").alias("chrom"), F.concat(F.lit("v"), F.col("variant_index").cast("string")).alias("snp"), F.lit(0.0).alias("cm"), (F.col("variant_index") + 1).alias("pos"), F.lit("A").alias("a1"), F.lit("G").alias("a2"))
    rows = cells.join(ids.hint("merge"), "id").select(F.col("variant").cast("long").alias("variant_index"), "sample_index", F.col("genotype").cast("double").alias("dosage"))
    prefix = f"{_fresh(spark, 'genotypes')}-set"
    sinks.write_genotype_set(rows, people, variants, prefix)
    read = formats.bed_at(spark, prefix, variants.select("chrom", "pos"))
    return read.groupBy("snp", "pos").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("genotype") == g).alias(f"n{g}") for g in range(3)], F.sum(F.col("iid").cast("long") * F.col("genotype")).alias("checksum"))


def q_cache_hit(spark, folder):
    """Per block and sample what a cache answers, to which generations from 12 on and then deeper evidence of generation 14 were committed."""
    reads = domain.reads(spark, folder)
    everyone = domain.samples(spark, folder)
    place = sites.blocks(domain.positions(spark, folder), BLOCK).select("chrom", F.col("block_id").alias("block"), "pos", "ref", "alt")

    def cells(min_mapq):
        counted = ev.evidence_counts(ev.usable(reads, min_mapq=min_mapq)).select("sample_id", "pos", F.col("depth").cast("long").alias("depth"))
        return counted.join(place.select("chrom", "block", "pos"), "pos")

    at, settings = _fresh(spark, "cache"), {"min_qual": 5}
    for min_mapq, least in ((55, 12), (20, 14)):
        some = everyone.where(F.col("generation") >= least).select("sample_id")
        evidencecache.store(cells(min_mapq).join(some, "sample_id", "left_semi"), place, some, at, settings)
    found, missing = evidencecache.lookup(spark, at, place, everyone, settings, _VALUES)
    hit = found.groupBy("chrom", "block", "sample_id").agg(F.sum("depth").alias("depth"), F.lit(False).alias("is_missing"))
    return hit.unionByName(missing.select("chrom", "block", "sample_id", F.lit(0).cast("long").alias("depth"), F.lit(True).alias("is_missing")))


def q_site_hashes(spark, folder):
    """Identity of every block of sites."""
    place = sites.blocks(domain.positions(spark, folder), BLOCK).select("chrom", F.col("block_id").alias("block"), "pos", "ref", "alt")
    return evidencecache.site_hashes(place)


QUERIES = {f.__name__: f for f in (q_genotype_set, q_cache_hit, q_site_hashes)}

_PLACE = f"""place as (select chrom, (row_number() over (partition by chrom order by pos) - 1) // {BLOCK} as block, pos, ref, alt from positions)"""

ORACLE_SQL = {
    "q_genotype_set": with_tables("matrix", """m as (select 'v' || variant as snp, (variant + 1)::bigint as pos, id, genotype from matrix)
select snp, pos, count(*) as n, count(*) filter (where genotype = 0) as n0, count(*) filter (where genotype = 1) as n1, count(*) filter (where genotype = 2) as n2,
       sum(id * genotype)::bigint as checksum from m group by all"""),
    "q_cache_hit": with_tables("reads positions samples", f"""{_PLACE},
usable as (select r.* exclude (qual), least(qual, mapq) as qual from reads r join samples using (sample_id)
  where generation >= 12 and mapq >= case when generation >= 14 then 20 else 55 end and least(qual, mapq) >= 5),
{COUNTS}
select chrom, block, sample_id, sum(depth)::bigint as depth, false as is_missing from evidence join place using (pos) group by all
union all select chrom, block, sample_id, 0::bigint, true from (select distinct chrom, block from place), samples where generation < 12"""),
    "q_site_hashes": with_tables("positions", f"""{_PLACE}
select chrom, block, count(*) as n_sites, sha256(string_agg(pos || chr(0) || ref || chr(0) || alt, chr(1) order by pos, ref, alt)) as sites_hash from place group by all"""),
}
