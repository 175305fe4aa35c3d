"""Per-variant quality figures in one aggregation, and their summary against thresholds in another."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.operators.posterior import argmax, confidence, dosage, entropy, site_statistics

#: For each check the column, whether high or low values are bad, and where it warns and fails.
CHECKS = {
    "het_rate": ("high", 0.8, 0.95),
    "hard_het_rate": ("high", 0.8, 0.95),
    "hom_rate": ("high", 0.98, 1.0),
    "hard_hom_rate": ("high", 0.98, 1.0),
    "missing_rate": ("high", 0.2, 0.5),
    "info": ("low", 0.3, 0.0),
    "mean_max_gp": ("low", 0.7, 0.5),
}
SUMMARISED = (
    "maf", "het_rate", "hom_rate", "hard_het_rate", "hard_hom_rate", "missing_rate", "info", "mean_entropy", "mean_max_gp", "mean_depth",
    "support_rate", "calibration_abs_dosage_shift", "calibration_abs_maf_shift",
)


def variant_diagnostics(cells: DataFrame, samples: int, least: float = 0.0) -> DataFrame:
    """One row for each position. cells: pos, depth, raw and gp (diploid arrays) of covered cells; samples: how many there are.

    A cell is called if its confidence reaches `least`; what is not in cells is missing. Rates of calls are shares of all
    samples, posterior rates and means are over the cells.
    """
    g, r = F.col("gp"), F.col("raw")
    called = confidence(g) >= least
    call = argmax(g)

    def rate(hit: Column) -> Column:
        return F.count_if(called & hit) / samples

    het, ref, alt = (F.avg(F.get(g, F.lit(i))) for i in (1, 0, 2))
    raw_af, af = F.avg(dosage(r)) / 2, F.avg(dosage(g)) / 2
    out = cells.groupBy("pos").agg(
        (F.count_if(called) / samples).alias("calling_rate"),
        het.alias("het_rate"),
        F.greatest(ref, alt).alias("hom_rate"),
        rate(call == 1).alias("hard_het_rate"),
        F.greatest(rate(call == 0), rate(call == 2)).alias("hard_hom_rate"),
        F.avg(entropy(g)).alias("mean_entropy"),
        F.avg(confidence(g)).alias("mean_max_gp"),
        (F.sum("depth") / samples).alias("mean_depth"),
        (F.count_if(F.col("depth") > 0) / samples).alias("support_rate"),
        F.avg(F.abs(dosage(g) - dosage(r))).alias("calibration_abs_dosage_shift"),
        (het - F.avg(F.get(r, F.lit(1)))).alias("calibration_het_rate_shift"),
        F.abs(F.least(af, 1 - af) - F.least(raw_af, 1 - raw_af)).alias("calibration_abs_maf_shift"),
    )
    out = out.withColumn("missing_rate", 1 - F.col("calling_rate")).withColumn("n_samples", F.lit(samples).cast("long"))
    return out.join(site_statistics(cells).drop("n"), "pos")


def summary(diagnostics: DataFrame, checks: Mapping[str, tuple[str, float, float]] = CHECKS) -> DataFrame:
    """One row: n_variants, for each check how many variants warn and fail, means and medians, and status ok, warn, fail or empty."""
    def count(name: str, at: float) -> Column:
        return F.count_if(F.col(name) >= at if checks[name][0] == "high" else F.col(name) <= at)

    out = diagnostics.agg(
        F.count(F.lit(1)).alias("n_variants"),
        *[count(n, checks[n][1 + i]).alias(f"{n}_{kind}") for n in checks for i, kind in enumerate(("warn", "fail"))],
        *[f(n).alias(f"{n}_{name}") for n in SUMMARISED for f, name in ((F.avg, "mean"), (F.median, "median"))],
    )
    fails, warns = (F.greatest(*[F.col(f"{n}_{kind}") for n in checks]) > 0 for kind in ("fail", "warn"))
    return out.withColumn("status", F.when(F.col("n_variants") == 0, "empty").when(fails, "fail").when(warns, "warn").otherwise("ok"))
