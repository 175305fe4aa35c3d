"""Sites, samples, blocks, genetic maps, recombination and founders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE_LOW, RATE_HIGH = 1e-10, 0.25
#: Spellings of sex, after trimming and lower-casing.
MALE = ("m", "male", "1", "xy")
FEMALE = ("f", "female", "2", "xx")
#: Spellings of a variant type.
TYPE_ALIASES = {"ins": "insertion", "insertion": "insertion", "del": "deletion", "deletion": "deletion", "snp": "snp", "snv": "snp"}


def variant_type(ref: Column, alt: Column) -> Column:
    """snp, insertion or deletion; `invalid` for several or no alternative alleles and for other changes."""
    bad = alt.isNull() | ref.isNull() | (alt == "") | (ref == "") | alt.contains(",") | (alt == ".") | (ref == ".")
    return (
        F.when(bad, "invalid")
        .when((F.length(ref) == 1) & (F.length(alt) == 1), "snp")
        .when(F.startswith(alt, ref) & (F.length(alt) > F.length(ref)), "insertion")
        .when(F.startswith(ref, alt) & (F.length(ref) > F.length(alt)), "deletion")
        .otherwise("invalid")
    )


def normalised_positions(positions: DataFrame, max_indel: int = 50) -> DataFrame:
    """Positions with variant_type, indel length and whether the row may be used; (chrom, pos) that occur again are not."""
    length = F.abs(F.length("alt") - F.length("ref"))
    again = F.count(F.lit(1)).over(Window.partitionBy("chrom", "pos"))
    out = positions.withColumn("variant_type", variant_type(F.col("ref"), F.col("alt"))).withColumn("indel_length", length)
    fits = (F.col("variant_type") == "snp") | ((length > 0) & (length <= max_indel))
    return out.withColumn("usable", (F.col("variant_type") != "invalid") & fits & (again == 1))


def same_chromosome(a: Column, b: Column) -> Column:
    """Whether two names agree, with or without a leading chr."""
    return F.regexp_replace(a, "^chr", "") == F.regexp_replace(b, "^chr", "")


def ploidy(sex: Column, default: int = 2, male: int = 1, female: int = 2) -> Column:
    """Ploidy by sex where it is known, else the default."""
    s = F.lower(F.trim(sex))
    return F.when(s.isin(*MALE), male).when(s.isin(*FEMALE), female).otherwise(default)


def ranked(positions: DataFrame) -> DataFrame:
    """Positions with site_index from 0 in each chromosome."""
    order = Window.partitionBy("chrom").orderBy("pos")
    return positions.withColumn("site_index", (F.row_number().over(order) - 1).cast("long"))


def blocks(positions: DataFrame, size: int) -> DataFrame:
    """Tiles of `size` neighbouring sites."""
    return ranked(positions).withColumn("block_id", F.floor(F.col("site_index") / size).cast("long"))


def overlapping_blocks(positions: DataFrame, size: int, least: int, share: float) -> DataFrame:
    """Every core tile with the sites within max(least, ceil(size * share)) beyond it; is_core marks the tile's own.

    A site goes to its own tile and to the neighbours it is near: no site is compared with another.
    """
    import math

    reach = max(least, math.ceil(size * share))
    rows = blocks(positions, size).withColumn("n_sites", F.count(F.lit(1)).over(Window.partitionBy("chrom")))
    last = F.floor((F.col("n_sites") - 1) / size)
    low = F.greatest(F.lit(0), F.floor((F.col("site_index") - reach - size) / size) + 1)
    high = F.least(last, F.floor((F.col("site_index") + reach) / size))
    out = rows.withColumn("overlap_block", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    return out.withColumn("is_core", F.col("overlap_block") == F.col("block_id"))


def recombination(positions: DataFrame) -> DataFrame:
    """Positions with distance to the one before in bp and cM and the rate: cM / 100, held in [1e-10, 0.25], first 1e-10."""
    order = Window.partitionBy("chrom").orderBy("pos")
    out = positions.withColumn("bp", F.col("pos") - F.lag("pos").over(order)).withColumn("dcm", F.col("cm") - F.lag("cm").over(order))
    rate = F.least(F.lit(RATE_HIGH), F.greatest(F.lit(RATE_LOW), F.coalesce(F.col("dcm") / 100, F.col("bp") * 1e-8)))
    return out.withColumn("rate", F.when(F.col("bp").isNull(), RATE_LOW).otherwise(rate))


def switch_probability(rate: Column, generation: Column) -> Column:
    """1 - exp(-generation * rate), held in [1e-10, 1 - 1e-10]."""
    return F.least(F.lit(1 - 1e-10), F.greatest(F.lit(1e-10), 1 - F.exp(-generation * rate)))


def transition_summary(positions: DataFrame, samples: DataFrame, n_founders: int) -> DataFrame:
    """Per interval the distribution over samples of the switch probability and its derived means."""
    # the samples' generations are a small table beside sites; the join is on nothing because every site needs every sample
    generations = samples.groupBy("generation").agg(F.count(F.lit(1)).alias("n"))
    sites = recombination(positions).where("bp is not null")
    cells = sites.join(F.broadcast(generations))
    cells = cells.withColumn("switch", switch_probability(F.col("rate"), F.col("generation")))
    each = cells.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    s = F.col("switch")
    return each.groupBy("chrom", "pos").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(s).alias("switch_mean"),
        F.median(s).alias("switch_median"),
        F.min(s).alias("switch_min"),
        F.max(s).alias("switch_max"),
        F.percentile(s, F.lit(0.95)).alias("switch_p95"),
        F.avg(1 - s).alias("stay_mean"),
        F.avg(s / max(n_founders - 1, 1)).alias("offdiag_mean"),
        F.avg(1 - (1 - s) * (1 - s)).alias("any_switch_mean"),
    )


def interpolated(sites: DataFrame, genetic_map: DataFrame) -> DataFrame:
    """cM of each site between the map points around it, held at the map's ends: an as-of join in both directions.

    Both tables are united and sorted both ways in each chromosome, and the last map point of either way is carried along: a frame that
    ends at the row is a running value, while one that reaches to the partition's end is made anew for each row.
    sites: chrom, pos; genetic_map: chrom, pos, cm, where the first of equal positions counts.
    """
    points = genetic_map.groupBy("chrom", "pos").agg(F.min("cm").alias("cm"))
    both = sites.select("chrom", "pos", F.lit(None).cast("double").alias("cm"), F.lit(1).alias("is_site")).unionByName(
        points.select("chrom", "pos", "cm", F.lit(0).alias("is_site"))
    )
    up = Window.partitionBy("chrom").orderBy("pos", "is_site").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("chrom").orderBy(F.desc("pos"), "is_site").rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col("is_site") == 0, F.struct("pos", "cm"))
    near = both.withColumn("a", F.last(point, ignorenulls=True).over(up)).withColumn("b", F.last(point, ignorenulls=True).over(down))
    a, b = F.col("a"), F.col("b")
    share = (F.col("pos") - a["pos"]) / (b["pos"] - a["pos"])
    line = F.when(a.isNull(), b["cm"]).when(b.isNull(), a["cm"]).when(a["pos"] == b["pos"], a["cm"]).otherwise(a["cm"] + share * (b["cm"] - a["cm"]))
    return near.where("is_site = 1").select("chrom", "pos", line.alias("cm"))


def with_defaults(positions: DataFrame, panel: DataFrame, founders: DataFrame, default: float = 0.5) -> DataFrame:
    """alt_prob of every founder at every position, `default` where the panel has none."""
    grid = positions.select("pos").join(F.broadcast(founders.select("founder")))
    return grid.join(panel, ["pos", "founder"], "left").select("pos", "founder", F.coalesce("alt_prob", F.lit(default)).alias("alt_prob"))


def padded(panel: DataFrame, n_founders: int) -> DataFrame:
    """The panel with mutable founders at 0.5 up to `n_founders`; immutable marks the given ones."""
    known = panel.withColumn("immutable", F.lit(1))
    have = panel.groupBy("pos").agg(F.max("founder").alias("top"))
    more = have.where(F.col("top") + 1 < n_founders).select(
        "pos", F.explode(F.sequence(F.col("top") + 1, F.lit(n_founders - 1).cast("long"))).alias("founder"), F.lit(0.5).alias("alt_prob"), F.lit(0).alias("immutable")
    )
    return known.select("pos", "founder", "alt_prob", "immutable").unionByName(more)


def founder_diversity(panel: DataFrame) -> DataFrame:
    """Mean, median and minimum over positions of the spread of founders, for positions with more than one."""
    each = panel.groupBy("pos").agg(
        F.stddev_samp("alt_prob").alias("sd"), F.min("alt_prob").alias("low"), F.max("alt_prob").alias("high"), F.count("alt_prob").alias("n")
    ).where("n > 1")
    return each.agg(
        F.count(F.lit(1)).alias("n_positions"),
        F.avg("sd").alias("sd_mean"),
        F.median("sd").alias("sd_median"),
        F.min("sd").alias("sd_min"),
        F.avg(F.col("high") - F.col("low")).alias("range_mean"),
    )


def hotspot_windows(positions: DataFrame, window: int, shrink: float = 20.0) -> DataFrame:
    """Rate of each bp window against the median window, shrunk by n / (n + shrink) and held in [0.25, 4]."""
    each = recombination(positions).where("bp is not null").withColumn("window", F.floor(F.col("pos") / window).cast("long"))
    each = each.groupBy("chrom", "window").agg(F.avg("rate").alias("rate"), F.count(F.lit(1)).alias("n"))
    middle = each.groupBy("chrom").agg(F.median("rate").alias("middle"))
    ratio = F.col("rate") / F.greatest(F.col("middle"), F.lit(RATE_LOW))
    shrunk = 1 + (ratio - 1) * F.col("n") / (F.col("n") + shrink)
    return each.join(middle, "chrom").select("chrom", "window", "n", F.least(F.lit(4.0), F.greatest(F.lit(0.25), shrunk)).alias("multiplier"))
