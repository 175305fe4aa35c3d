"""From observed bases to per-site evidence, fragments and truth labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Counts are held in 16 bits.
MOST_COUNT = 65535


def usable(reads: DataFrame, min_mapq: int = 20, min_qual: int = 5) -> DataFrame:
    """Reads of sufficient mapping quality, base quality capped by it and of at least `min_qual`."""
    return (
        reads.where(F.col("mapq") >= min_mapq)
        .withColumn("qual", F.least("qual", "mapq"))
        .where(F.col("qual") >= min_qual)
    )


def weight(qual: Column) -> Column:
    """1 - 10 ** (-q / 10)."""
    return 1 - F.pow(F.lit(10.0), -qual / 10.0)


def evidence_counts(reads: DataFrame, keys: tuple[str, ...] = ("sample_id", "pos")) -> DataFrame:
    """Counts and summed quality weights of reference, alternative and other bases; partial sums come before the shuffle."""
    def n(code: int) -> Column:
        return F.least(F.count_if(F.col("code") == code), F.lit(MOST_COUNT)).alias(f"{NAMES[code]}_count")

    def w(code: int) -> Column:
        return F.round(F.sum(F.when(F.col("code") == code, weight(F.col("qual"))).otherwise(0.0)), 6).alias(f"{NAMES[code]}_weight")

    depth = F.least(F.count(F.lit(1)), F.lit(MOST_COUNT)).alias("depth")
    return reads.groupBy(*keys).agg(depth, *[n(c) for c in range(3)], *[w(c) for c in range(3)])


NAMES = ("ref", "alt", "other")


def truth_labels(
    evidence: DataFrame,
    min_depth: int = 3,
    min_hom_depth: int = 3,
    min_het_depth: int = 4,
    min_het_allele_depth: int = 2,
    hom_major: float = 0.95,
    het_balance: tuple[float, float] = (0.25, 0.75),
    max_other: float = 0.05,
) -> DataFrame:
    """Evidence plus truth: 0, 1 or 2 alternative alleles where reads are clear, else -1.

    Rules apply in the order homozygous reference, heterozygous, homozygous alternative; the last that holds wins.
    """
    ref, alt, other = (F.col(f"{n}_count").cast("double") for n in NAMES)
    both = ref + alt
    alt_share = F.when(both > 0, alt / F.greatest(both, F.lit(1.0))).otherwise(0.0)
    ref_share = F.when(both > 0, ref / F.greatest(both, F.lit(1.0))).otherwise(0.0)
    other_share = F.when(both + other > 0, other / (both + other)).otherwise(0.0)
    clear = (both >= min_depth) & (other_share <= max_other)
    hom_alt = clear & (alt >= min_hom_depth) & (alt_share >= hom_major)
    het = (
        clear
        & (both >= min_het_depth)
        & (ref >= min_het_allele_depth)
        & (alt >= min_het_allele_depth)
        & alt_share.between(*het_balance)
    )
    hom_ref = clear & (ref >= min_hom_depth) & (ref_share >= hom_major)
    return evidence.withColumn("truth", F.when(hom_alt, 2).when(het, 1).when(hom_ref, 0).otherwise(-1))


def compressed(fragments: DataFrame) -> DataFrame:
    """One observation per (sample, fragment, position): the one of highest quality, the first of these."""
    best = Window.partitionBy("sample_id", "fragment", "pos").orderBy(F.desc("qual"), "ord", "code")
    return fragments.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def centres(fragments: DataFrame) -> DataFrame:
    """Per fragment its size and centre: the position nearest the mean position, the first on ties."""
    own = Window.partitionBy("sample_id", "fragment")
    near = fragments.select("sample_id", "fragment", "pos", F.avg("pos").over(own).alias("mean_pos"), F.count(F.lit(1)).over(own).alias("n_obs"))
    return near.groupBy("sample_id", "fragment", "n_obs").agg(
        F.min(F.struct(F.abs(F.col("pos") - F.col("mean_pos")).alias("d"), F.col("pos"))).getField("pos").alias("center")
    )


def merged_fragments(reads: DataFrame, mates: int = 2, most: int = 4) -> DataFrame:
    """fragment_key and part of each read: every `mates` reads of one name in order make a fragment, cut after `most` observations.

    The reads of a name are ordered by position and then by `ord`; the sub-key is ceil(rank / mates).
    """
    order = Window.partitionBy("sample_id", "fragment").orderBy("pos", "ord")
    rank = F.row_number().over(order)
    return reads.withColumn("mate_pair", F.ceil(rank / mates).cast("int")).withColumn("flush", F.floor((rank - 1) / most).cast("int"))


def held_out(fragments: DataFrame, every: int = 5, fold: int = 0) -> DataFrame:
    """Fragments with is_held: a fixed arithmetic share of a sample's fragments, at least one on each side."""
    own = Window.partitionBy("sample_id")
    held = (F.pmod(F.col("fragment") * 7919 + F.col("sample_id"), F.lit(every)) == fold).cast("int")
    rows = fragments.withColumn("held", held)
    first = F.col("fragment") == F.min("fragment").over(own)
    last = F.col("fragment") == F.max("fragment").over(own)
    none, all_ = F.max("held").over(own) == 0, F.min("held").over(own) == 1
    return rows.withColumn("is_held", F.when(none & first, True).when(all_ & last, False).otherwise(F.col("held") == 1)).drop("held")


def site_alt_fraction(evidence: DataFrame) -> DataFrame:
    """(alt + 0.5) / (depth + 1) of each site over samples, 0.5 without reference or alternative reads."""
    return evidence.groupBy("pos").agg(F.sum("alt_count").alias("alt"), F.sum(F.col("alt_count") + F.col("ref_count")).alias("depth")).select(
        "pos", F.when(F.col("depth") > 0, (F.col("alt") + 0.5) / (F.col("depth") + 1)).otherwise(0.5).alias("alt_fraction")
    )
