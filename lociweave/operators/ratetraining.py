"""Recombination rates trained on founder posteriors: a scale for each chromosome and multipliers for windows of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.operators import hmm
from lociweave.operators.posterior import clipped
from lociweave.operators.sites import RATE_HIGH, RATE_LOW, recombination
from lociweave.sources.scratch import forget, never_broadcast, written

#: The range of scales and multipliers, the range of switch proxies' distance from 0 and 1, intervals that count as much as no change.
LEAST, MOST, EDGE, PRIOR = 0.25, 4.0, 1e-6, 20.0


def interval_switches(haps: DataFrame) -> DataFrame:
    """(chrom, pos, switch): the median over samples of one minus the product of founder shares at a site and the one before it.

    haps: sample_id, chrom, pos, hap. Samples without a site are not in its medians; nulls never.
    """
    order = Window.partitionBy("sample_id", "chrom").orderBy("pos")
    rows = haps.where("hap is not null").select("sample_id", "chrom", "pos", "hap", F.lag("hap").over(order).alias("before")).where("before is not null")
    same = F.aggregate(F.zip_with("hap", "before", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    return rows.select("chrom", "pos", clipped(1 - same, EDGE, 1 - EDGE).alias("switch")).groupBy("chrom", "pos").agg(F.median("switch").alias("switch"))


def trained_rates(haps: DataFrame, positions: DataFrame, samples: DataFrame, overall: bool = True, window: int = 0) -> DataFrame:
    """(chrom, pos, rate_before, scale, multiplier, rate) of every site.

    An interval's effective rate is -log(1 - switch) by the median positive generation (1 without any), its ratio that by the rate on the
    map. `overall` multiplies a chromosome's rates by the median ratio, held in [0.25, 4]. Windows of `window` bp from the chromosome's
    first site (0: none) with two intervals or more multiply by the ratio of their held median to the scale, drawn to 1 as n / (n + 20)
    says. Rates stay in [1e-10, 0.25]; a chromosome's first site has 1e-10, and sites without posteriors keep scale and no multiplier.
    What meets in one group are the intervals of a chromosome, one number each, not the cells.
    """
    return rates_of_switches(interval_switches(haps), positions, samples, overall, window)


def rates_of_switches(switches: DataFrame, positions: DataFrame, samples: DataFrame, overall: bool = True, window: int = 0) -> DataFrame:
    """`trained_rates` of what `interval_switches` or `hmm.scanned_switches` returns."""
    first = F.min("pos").over(Window.partitionBy("chrom"))
    base = recombination(positions).select("chrom", "pos", F.col("rate").alias("rate_before"), F.col("bp").isNull().alias("is_first"), (F.col("pos") - first).alias("offset"))
    base = base.withColumn("window", F.floor(F.col("offset") / max(window, 1)).cast("long"))
    age = samples.where("generation > 0 and not isnan(generation) and generation < double('infinity')").agg(F.coalesce(F.median("generation"), F.lit(1.0)).alias("age"))
    # one row
    seen = base.where(~F.col("is_first")).join(never_broadcast(switches), ["chrom", "pos"]).join(F.broadcast(age))
    ratio = -F.log1p(-F.col("switch")) / F.greatest("age", F.lit(1e-6)) / F.greatest("rate_before", F.lit(RATE_LOW))
    seen = written(seen.select("chrom", "pos", "window", ratio.alias("ratio")).where("ratio > 0"))
    scales = seen.groupBy("chrom").agg(clipped(F.median("ratio"), LEAST, MOST).alias("middle"))
    scale = F.coalesce("middle", F.lit(1.0)) if overall else F.lit(1.0)
    out = base.join(scales, "chrom", "left").withColumn("scale", scale)
    if window > 0:
        local = seen.groupBy("chrom", "window").agg(clipped(F.median("ratio"), LEAST, MOST).alias("local"), F.count(F.lit(1)).alias("n")).where("n >= 2")
        valid = seen.select("chrom", "pos", F.lit(True).alias("valid"))
        out = out.join(never_broadcast(local), ["chrom", "window"], "left").join(never_broadcast(valid), ["chrom", "pos"], "left")
        shrunk = 1 + F.col("n") / (F.col("n") + PRIOR) * (F.col("local") / F.col("scale") - 1)
        multiplier = F.when(F.col("valid") & F.col("n").isNotNull(), clipped(shrunk, LEAST, MOST)).otherwise(1.0)
    else:
        multiplier = F.lit(1.0)
    out = out.withColumn("multiplier", multiplier)
    rate = F.when(F.col("is_first"), RATE_LOW).otherwise(clipped(F.col("rate_before") * F.col("scale") * F.col("multiplier"), RATE_LOW, RATE_HIGH))
    return out.select("chrom", "pos", "rate_before", "scale", "multiplier", rate.alias("rate"))


def summary(rates: DataFrame) -> DataFrame:
    """Per chromosome: scale, sites whose window has a multiplier, and the median rates before and after, first sites left out where there are more."""
    inner = F.row_number().over(Window.partitionBy("chrom").orderBy("pos")) > 1
    rows = rates.withColumn("inner", inner).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("chrom"))).where("inner or n = 1")
    return rows.groupBy("chrom").agg(
        F.first("scale").alias("scale"), F.count_if(F.col("multiplier") != 1).alias("n_adjusted"),
        F.median("rate_before").alias("median_rate_before"), F.median("rate").alias("median_rate_after"),
    )


def remapped(positions: DataFrame, rates: DataFrame) -> DataFrame:
    """Positions whose centimorgans are the running sums of the rates, so that every later job uses these."""
    order = Window.partitionBy("chrom").orderBy("pos")
    own = rates.select("chrom", "pos", F.coalesce(F.sum(F.col("rate") * 100).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)).alias("cm"))
    return positions.drop("cm").join(own, ["chrom", "pos"])


def trained_positions(evidence: DataFrame, positions: DataFrame, samples: DataFrame, panel: DataFrame, ploidy: int = 2, rounds: int = 1, overall: bool = True, window: int = 0) -> DataFrame:
    """Positions after `rounds` of posteriors and training; each round's map is written and read by the next. Without overall and window they stay as they are."""
    if not overall and window <= 0:
        return positions
    held = None
    for _ in range(rounds):
        switches = hmm.scanned_switches(evidence, positions, samples, panel, ploidy, EDGE)
        after = written(remapped(positions, rates_of_switches(switches, positions, samples, overall, window)))
        forget(held)
        positions = held = after
    return positions
