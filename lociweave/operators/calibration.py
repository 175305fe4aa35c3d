"""Calibration and callability: strata, thresholds, scans and agreement metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.operators import posterior as gp_


def digitised(x: Column, edges: tuple[float, ...]) -> Column:
    """How many inner edges are at most x."""
    out = F.lit(0)
    for e in edges[1:-1]:
        out = out + F.when(x >= e, 1).otherwise(0)
    return out


def strata(sites: DataFrame, bins: dict[str, tuple[float, ...]]) -> DataFrame:
    """Sites with stratum: the bins of their statistics as digits of one number."""
    out = F.lit(0)
    for name, edges in bins.items():
        out = out * (len(edges) - 1) + digitised(F.col(name), edges)
    return sites.withColumn("stratum", out.cast("int"))


def capped_calls(cells: DataFrame, threshold: float, cap: float, mode: str = "log_max_gp") -> DataFrame:
    """Calls whose score reaches the threshold, which is lowered where more than `cap` of a site's samples would go.

    The cap's threshold is the site's score at rank floor(cap * n), so ranks of one site are all that is compared.
    """
    score = cells.withColumn("score", gp_.call_score(F.col("gp"), mode))
    site = Window.partitionBy("pos")
    ranked = score.withColumn("n", F.count(F.lit(1)).over(site)).withColumn("k", F.row_number().over(site.orderBy("score", "sample_id")) - 1)
    most = F.floor(cap * F.col("n"))
    at = F.min(F.when(F.col("k") == F.greatest(most, F.lit(0)), F.col("score"))).over(site)
    limit = F.least(F.lit(threshold), F.coalesce(at, F.lit(float("inf"))))
    return ranked.withColumn("call", F.when(F.col("score") >= limit, gp_.argmax(F.col("gp"))).otherwise(-1)).drop("k", "n")


def confusion(cells: DataFrame, *keys: str) -> DataFrame:
    """Counts of (truth, pred) among cells with both."""
    return cells.where("truth >= 0 and pred >= 0").groupBy(*keys, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def agreement(counts: DataFrame, *keys: str) -> DataFrame:
    """macro_f1 over classes seen in truth or prediction and balanced accuracy over classes of truth, from `confusion`."""
    truth = counts.groupBy(*keys, F.col("truth").alias("cls")).agg(F.sum("n").alias("n_true"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    pred = counts.groupBy(*keys, F.col("pred").alias("cls")).agg(F.sum("n").alias("n_pred"))
    both = truth.join(pred, [*keys, "cls"], "full").na.fill(0, ["n_true", "n_pred", "tp"])
    f1 = 2 * F.col("tp") / (F.col("n_true") + F.col("n_pred"))
    return both.groupBy(*keys).agg(
        F.avg(f1).alias("macro_f1"), F.avg(F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true"))).alias("balanced_accuracy"), F.sum("n_true").alias("n_called")
    )


def threshold_scan(
    cells: DataFrame, thresholds: list[float], min_call_rate: float = 0.2, max_call_rate: float | None = None, weights: tuple[float, float, float] = (0.5, 0.5, 0.03)
) -> DataFrame:
    """Per threshold: call rate, agreement and objective; `best` marks the largest objective, the smallest threshold on ties.

    cells: truth, pred, prob. Each cell is counted once, in the largest threshold that it reaches; sums from there on
    give every threshold's counts, so the cells are read once however many thresholds there are.
    """
    steps = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    level = F.size(F.filter(steps, lambda t: t <= F.col("prob")))
    binned = cells.where("truth >= 0 and pred >= 0").groupBy(level.alias("level"), "truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    grid = F.explode(F.sequence(F.lit(1), F.col("level")))
    # at most thresholds * classes^2 rows from here on
    spread = binned.where("level > 0").withColumn("step", grid)
    counts = spread.groupBy("step", "truth", "pred").agg(F.sum("n").alias("n"))
    whole = binned.agg(F.sum("n").alias("n_all"))
    out = agreement(counts, "step").join(F.broadcast(whole)).withColumn("call_rate", F.col("n_called") / F.col("n_all"))
    out = out.withColumn("threshold", F.get(steps, F.col("step") - 1))
    out = out.where(F.col("call_rate") >= min_call_rate)
    if max_call_rate is not None:
        out = out.where(F.col("call_rate") <= max_call_rate)
    objective = weights[0] * F.col("balanced_accuracy") + weights[1] * F.col("macro_f1") + weights[2] * F.col("call_rate")
    out = out.select("threshold", "call_rate", "macro_f1", "balanced_accuracy", F.round(objective, 9).alias("objective"))
    first = out.agg(F.max(F.struct(F.col("objective"), (-F.col("threshold")).alias("t"))).alias("top"))
    return out.join(F.broadcast(first)).withColumn("best", F.col("threshold") == -F.col("top.t")).drop("top")


def call_statistics(calls: DataFrame, ploidy: int = 2) -> DataFrame:
    """One row over sites: mean MAF and heterozygosity of sites with calls, and mean call rate of all. calls: pos, call."""
    v = F.col("call") >= 0
    site = calls.groupBy("pos").agg(
        F.count_if(v).alias("called"), F.count(F.lit(1)).alias("n"), F.sum(F.when(v, F.col("call")).otherwise(0)).alias("alt"), F.count_if(F.col("call") == 1).alias("het")
    )
    af = gp_.clipped(F.col("alt") / F.greatest(F.col("called") * ploidy, F.lit(1)), 0.0, 1.0)
    some = F.col("called") > 0
    return site.agg(
        F.avg(F.when(some, F.least(af, 1 - af))).alias("mean_maf"),
        F.avg(F.when(some, F.col("het") / F.col("called"))).alias("mean_het_rate"),
        F.avg(F.col("called") / F.col("n")).alias("mean_call_rate"),
    )


def context(sites: DataFrame, value: str, reach: int) -> DataFrame:
    """Mean and population deviation of a site's neighbours within `reach`, the edge sites repeated beyond the ends. sites: chrom, pos, value."""
    order = Window.partitionBy("chrom").orderBy("pos")
    every = Window.partitionBy("chrom")
    out = sites.withColumn("k", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(every))
    near = order.rowsBetween(-reach, reach)
    first, last = F.first(value).over(order), F.max_by(value, "pos").over(every)
    before = F.greatest(F.lit(0), reach - F.col("k") + 1)
    after = F.greatest(F.lit(0), reach - (F.col("n") - F.col("k")))
    size = float(2 * reach + 1)
    x = F.col(value)
    s1 = F.sum(x).over(near) + before * first + after * last
    s2 = F.sum(x * x).over(near) + before * first * first + after * last * last
    return out.select("chrom", "pos", (s1 / size).alias("local_mean"), F.sqrt(F.greatest(F.lit(0.0), s2 / size - (s1 / size) * (s1 / size))).alias("local_std"))


def masked_grid(cells: DataFrame, temperatures: list[float], blends: list[float], prior_weights: list[float], edges: tuple[float, ...]) -> DataFrame:
    """Objective NLL + 0.25 Brier + 0.1 MSE of every parameter combination in every MAF bin; best marks the smallest.

    cells: raw gp `raw`, dosage, depth, truth, alt_af, maf. Every cell is expanded by the grid inside its task and summed
    there, so the shuffle carries bins times combinations.
    """
    grid = F.explode(
        F.array(*[F.struct(F.lit(t).alias("temperature"), F.lit(b).alias("blend"), F.lit(w).alias("prior_weight")) for t in temperatures for b in blends for w in prior_weights])
    )
    rows = cells.where("truth between 0 and 2").withColumn("maf_bin", digitised(F.col("maf"), edges)).withColumn("g", grid)
    heat = F.greatest(F.lit(1e-6), F.col("g.temperature") / F.sqrt(F.col("depth") + 1.0))
    soft = gp_.normalised(gp_.softmax(F.array(*[-F.pow(F.col("dosage") - g, F.lit(2.0)) / heat for g in range(3)])))
    rows = rows.withColumn("soft", soft).withColumn(
        "mix", gp_.normalised(F.zip_with("raw", "soft", lambda a, b: (1 - F.col("g.blend")) * a + F.col("g.blend") * b))
    )
    prior = gp_.hwe_prior(F.col("alt_af"))
    rows = rows.withColumn("gp", gp_.normalised(F.zip_with("mix", prior, lambda a, q: F.exp(F.log(gp_.clipped(a, 1e-6, 1.0)) + F.col("g.prior_weight") * F.log(gp_.clipped(q, 1e-6, 1.0))))))
    nll = -F.log(gp_.clipped(F.get("gp", F.col("truth")), 1e-6, 1.0))
    brier = gp_.total(F.transform("gp", lambda x, i: F.pow(x - F.when(i == F.col("truth"), 1.0).otherwise(0.0), F.lit(2.0)))) / 3
    mse = F.pow(gp_.dosage(F.col("gp")) - F.col("truth"), F.lit(2.0))
    out = rows.groupBy("maf_bin", "g.temperature", "g.blend", "g.prior_weight").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(nll) + 0.25 * F.avg(brier) + 0.1 * F.avg(mse), 8).alias("objective")
    )
    first = Window.partitionBy("maf_bin").orderBy("objective", "temperature", "blend", "prior_weight")
    return out.withColumn("best", F.row_number().over(first) == 1)


def guarded(
    cells: DataFrame,
    max_mean_abs_dosage_shift: float = 0.35,
    max_mean_abs_maf_shift: float = 0.20,
    max_het_rate_shift: float = 0.25,
    max_mean_abs_entropy_shift: float = 0.50,
) -> DataFrame:
    """`cells` (pos, raw, gp) with status; gp goes back to raw in all of them where any mean shift is beyond its limit.

    The shifts are one row, which every cell reads. Without cells there is nothing to return.
    """
    s = gp_.shifts(cells)
    beyond = (
        (F.col("mean_abs_dosage_shift") > max_mean_abs_dosage_shift)
        | (F.col("mean_abs_maf_shift") > max_mean_abs_maf_shift)
        | (F.abs("het_rate_shift") > max_het_rate_shift)
        | (F.col("mean_abs_entropy_shift") > max_mean_abs_entropy_shift)
    )
    verdict = s.select(F.when(beyond, "fallback_to_raw").otherwise("ok").alias("status"))
    out = cells.join(F.broadcast(verdict))
    return out.withColumn("gp", F.when(F.col("status") == "ok", F.col("gp")).otherwise(F.col("raw")))
