"""Candidate variants from reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")


def snp_candidates(
    bases: DataFrame, min_depth: int = 3, min_alt: int = 2, min_alt_samples: int = 1, min_alt_fraction: float = 0.05, max_other_fraction: float = 0.2
) -> DataFrame:
    """Sites with a second base: bases has sample_id, chrom, pos, ref, base, strand.

    The alternative is the most frequent non-reference base, the first of A, C, G, T on ties. Samples support a site
    with any non-reference base. Two partial aggregations, one shuffle on the site.
    """
    def n(base):
        return F.count_if(F.col("base") == base).alias(f"{base.lower()}_count")

    sites = bases.groupBy("chrom", "pos", "ref").agg(
        F.count(F.lit(1)).alias("depth"),
        *[n(b) for b in BASES],
        *[F.count_if((F.col("base") == b) & (F.col("strand") == "+")).alias(f"{b.lower()}_forward") for b in BASES],
        F.count_if(F.col("base") == F.col("ref")).alias("ref_count"),
        F.countDistinct(F.when(F.col("base") != F.col("ref"), F.col("sample_id"))).alias("sample_support"),
    )
    best = F.greatest(*[
        F.when(F.col("ref") != b, F.struct(F.col(f"{b.lower()}_count").alias("n"), F.lit(-i).alias("k"), F.lit(b).alias("base"), F.col(f"{b.lower()}_forward").alias("forward")))
        for i, b in enumerate(BASES)
    ])
    out = sites.withColumn("best", best).select(
        "chrom", "pos", "ref", F.col("best.base").alias("alt"), "depth", "ref_count", F.col("best.n").alias("alt_count"),
        (F.col("depth") - F.col("ref_count") - F.col("best.n")).alias("other_count"), "sample_support",
        F.col("best.forward").alias("alt_forward_count"), (F.col("best.n") - F.col("best.forward")).alias("alt_reverse_count"),
        *[f"{b.lower()}_count" for b in BASES],
    )
    out = out.withColumn("alt_fraction", F.col("alt_count") / F.col("depth")).withColumn("other_fraction", F.col("other_count") / F.col("depth"))
    return out.where(
        (F.col("depth") >= min_depth) & (F.col("alt_count") >= min_alt) & (F.col("sample_support") >= min_alt_samples)
        & (F.col("alt_fraction") >= min_alt_fraction) & (F.col("other_fraction") <= max_other_fraction)
    )


def indel_candidates(events: DataFrame, min_alt: int = 2, min_samples: int = 1) -> DataFrame:
    """Insertions and deletions by (chrom, pos, ref, alt): events has sample_id, chrom, pos, ref, alt, strand."""
    out = events.groupBy("chrom", "pos", "ref", "alt").agg(
        F.count(F.lit(1)).alias("alt_count"),
        F.countDistinct("sample_id").alias("sample_support"),
        F.count_if(F.col("strand") == "+").alias("alt_forward_count"),
        F.count_if(F.col("strand") == "-").alias("alt_reverse_count"),
    )
    kind = F.when(F.length("alt") > F.length("ref"), "insertion").otherwise("deletion")
    return out.where((F.col("alt_count") >= min_alt) & (F.col("sample_support") >= min_samples)).withColumn("variant_type", kind)
