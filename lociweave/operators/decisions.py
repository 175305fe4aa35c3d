"""No-call thresholds by class of sites, and callability decisions by level: all sites, stratum, window, site.

Cells are counted once, by site and by how many thresholds their score reaches. Groups of sites add these counts up, and
every threshold's calls are sums from its step on, so the work after the first aggregation does not depend on the samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.operators.calibration import agreement
from lociweave.operators.posterior import clipped
from lociweave.sources.scratch import never_broadcast, written

#: Weights of balanced accuracy, macro F1 and call rate in an objective, and sites of a local window.
ACCURACY, F1, RATE, WINDOW = 0.5, 0.5, 0.03, 101
#: Coarse to fine; a finer level that is accepted takes the place of a coarser one.
LEVELS = ("global", "feature_stratum", "local_window", "per_snp")


def reached(score: Column, thresholds: list[float]) -> Column:
    """How many thresholds are at most the score."""
    return F.size(F.filter(F.array(*[F.lit(float(t)) for t in sorted(thresholds)]), lambda t: t <= score))


def _objective(rate: Column) -> Column:
    return F.round(ACCURACY * F.col("balanced_accuracy") + F1 * F.col("macro_f1") + RATE * rate, 9)


def _by_step(counts: DataFrame, *keys: str, first: int = 1) -> DataFrame:
    """keys, step, macro_f1, balanced_accuracy, n_called of the calls that each step leaves; counts: keys, reach, truth, pred, n."""
    spread = counts.where(F.col("reach") >= first).withColumn("step", F.explode(F.sequence(F.lit(first), F.col("reach"))))
    return agreement(spread.groupBy(*keys, "step", "truth", "pred").agg(F.sum("n").alias("n")), *keys, "step")


def thresholds_by_class(
    cells: DataFrame, classes: DataFrame, thresholds: list[float], min_rows: int = 16, min_call_rate: float = 0.05, max_no_call_rate: float = 1.0
) -> DataFrame:
    """A no-call threshold for each class of sites, that of all sites where a class has too few rows or none better.

    cells: pos, score, pred, truth (below 0: no training cell); classes: pos, class_id. Returns class_id, n_variants, n_train_rows, threshold,
    objective, train_call_rate, train_f1, train_balanced_accuracy, fallback_to_global. The smallest threshold wins ties. With max_no_call_rate a
    class leaves thresholds out that would take more than that of any site's training cells. Without any training cell the threshold is -inf.
    """
    steps = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    train = cells.where("truth >= 0").join(never_broadcast(classes), "pos")
    counts = written(train.groupBy("class_id", "pos", reached(F.col("score"), thresholds).alias("reach"), "truth", "pred").agg(F.count(F.lit(1)).alias("n")))
    both = counts.unionByName(counts.withColumn("class_id", F.lit(None).cast("int")))  # no class: all of them
    both = both.withColumn("class_id", F.coalesce("class_id", F.lit(-1)))
    n = both.groupBy("class_id").agg(F.sum("n").alias("n_train_rows"))
    scan = _by_step(both, "class_id").join(n, "class_id").withColumn("rate", F.col("n_called") / F.col("n_train_rows")).where(F.col("rate") >= min_call_rate)
    scan = scan.withColumn("objective", _objective(F.col("rate"))).withColumn("threshold", F.get(steps, F.col("step") - 1))
    if max_no_call_rate < 1:
        site = counts.groupBy("class_id", "pos").agg(F.sum("n").alias("all"))
        lost = counts.where(F.col("reach") < len(thresholds)).withColumn("step", F.explode(F.sequence(F.col("reach") + 1, F.lit(len(thresholds)))))
        lost = lost.groupBy("class_id", "pos", "step").agg(F.sum("n").alias("lost")).join(never_broadcast(site), ["class_id", "pos"])
        worst = lost.groupBy("class_id", "step").agg(F.max(F.col("lost") / F.col("all")).alias("worst"))
        scan = scan.join(worst, ["class_id", "step"], "left").where((F.col("class_id") == -1) | (F.coalesce("worst", F.lit(0.0)) <= max_no_call_rate))
    top = F.max_by(F.struct("threshold", "objective", "rate", "macro_f1", "balanced_accuracy"), F.struct("objective", -F.col("threshold")))
    lowest = float("-inf")
    found = scan.where("class_id = -1").groupBy("class_id").agg(top.alias("b")).first()  # one row, or none
    all_threshold, all_objective = (found["b"]["threshold"], found["b"]["objective"]) if found else (lowest, lowest)
    own = scan.where((F.col("class_id") != -1) & (F.col("objective") > all_objective) & (F.col("n_train_rows") >= min_rows))
    own = own.groupBy("class_id").agg(top.alias("b"))
    out = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_variants")).join(n, "class_id", "left").join(own, "class_id", "left")
    return out.select(
        "class_id", "n_variants", F.coalesce("n_train_rows", F.lit(0)).cast("long").alias("n_train_rows"),
        F.coalesce("b.threshold", F.lit(all_threshold)).alias("threshold"), F.coalesce("b.objective", F.lit(all_objective)).alias("objective"),
        F.col("b.rate").alias("train_call_rate"), F.col("b.macro_f1").alias("train_f1"), F.col("b.balanced_accuracy").alias("train_balanced_accuracy"),
        F.col("b").isNull().alias("fallback_to_global"),
    )


def _population(counts: DataFrame, called: Column, *keys: str) -> DataFrame:
    """keys, maf, het: means over sites with calls, of the cells that `called` keeps. counts: keys, pos, pred, n."""
    n = F.when(called, F.col("n")).otherwise(0)
    site = counts.groupBy(*keys, "pos").agg(F.sum(n).alias("c"), F.sum(n * F.col("pred")).alias("alt"), F.sum(F.when(F.col("pred") == 1, n).otherwise(0)).alias("het"))
    af = clipped(F.col("alt") / (2.0 * F.col("c")), 0.0, 1.0)
    return site.where("c > 0").groupBy(*keys).agg(F.avg(F.least(af, 1 - af)).alias("maf"), F.avg(F.col("het") / F.col("c")).alias("het"))


def by_level(
    cells: DataFrame,
    sites: DataFrame,
    thresholds: list[float],
    raw_threshold: float,
    min_rows: int = 64,
    rate_delta: tuple[float, float] = (-0.02, 0.05),
    min_improvement: float = 0.0,
    max_maf_shift: float = 0.08,
    max_het_shift: float = 0.12,
) -> DataFrame:
    """For each site whether calls are gated by `prob` and where, from the finest level whose decision is accepted.

    cells: pos, pred, truth (below 0: no label), prob (that the call is right), conf (the raw call's confidence); sites: pos, site_index (from 0 in
    order), stratum. A group of sites takes the threshold with the largest objective whose call rate over all its cells is within rate_delta of the raw
    calls' (conf of raw_threshold or more), the smallest on ties. It is accepted with enough labels, an objective on labels not below
    the raw calls' by min_improvement, and mean MAF and heterozygosity of calls not shifted too far. Last, single sites whose own call rate or calls
    shift too far go back to raw calls. Returns pos, n_labeled, calibration_used, decision_source, fallback_reason, threshold, call_rate_raw,
    call_rate_calibrated, call_rate_delta, objective_delta, maf_shift, het_shift.
    """
    key = ["level", "grp"]
    steps = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    raw = F.col("conf") >= raw_threshold
    label = F.when((F.col("truth") >= 0) & (F.col("pred") >= 0), F.col("truth")).otherwise(-1)
    counts = written(cells.groupBy("pos", reached(F.col("prob"), thresholds).alias("reach"), raw.alias("raw"), label.alias("truth"), "pred").agg(F.count(F.lit(1)).alias("n")))
    numbers = (F.lit(0), F.col("stratum"), F.floor(F.col("site_index") / WINDOW), F.col("site_index"))
    of = written(sites.select("pos", "site_index", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), x.cast("long").alias("grp")) for i, x in enumerate(numbers)])).alias("g")).select("pos", "site_index", "g.level", "g.grp"))
    at = counts.join(never_broadcast(of), "pos")
    sums = written(at.groupBy(*key, "reach", "raw", "truth", "pred").agg(F.sum("n").alias("n")))  # all sites' group is small after partial sums
    size = sums.groupBy(*key).agg(
        F.sum("n").alias("n_cells"), F.sum(F.when(F.col("truth") >= 0, F.col("n")).otherwise(0)).alias("n_labeled"), F.sum(F.when(F.col("raw"), F.col("n")).otherwise(0)).alias("n_raw")
    ).withColumn("raw_rate", F.col("n_raw") / F.col("n_cells"))
    labels = sums.where("truth >= 0")
    before = agreement(labels.where("raw").groupBy(*key, "truth", "pred").agg(F.sum("n").alias("n")), *key).join(never_broadcast(size.select(*key, "n_labeled")), key)
    before = before.select(*key, _objective(F.col("n_called") / F.col("n_labeled")).alias("raw_objective"))
    rates = sums.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("reach")))).groupBy(*key, "step").agg(F.sum("n").alias("kept"))
    scan = _by_step(labels, *key, first=0).join(never_broadcast(rates), [*key, "step"]).join(never_broadcast(size), key).withColumn("rate", F.col("kept") / F.col("n_cells"))
    low = F.greatest(F.lit(0.0), F.col("raw_rate") + rate_delta[0])
    high = F.greatest(low, F.least(F.lit(1.0), F.col("raw_rate") + rate_delta[1]))
    fits = (F.col("step") > 0) & (F.col("rate") >= low) & (F.col("rate") <= high)
    scan = scan.withColumn("score", F.when(fits, _objective(F.col("rate")))).withColumn("own_objective", _objective(F.col("n_called") / F.col("n_labeled")))
    # without a threshold that fits, everything is called: step 0
    order = F.struct(F.coalesce("score", F.lit(-1.0)), -F.col("step"))
    chosen = scan.groupBy(*key).agg(F.max_by(F.struct("step", "score", "rate", "own_objective"), order).alias("b")).select(*key, "b.*")
    chosen = written(size.join(never_broadcast(chosen), key, "left").join(never_broadcast(before), key, "left"))
    gated = at.join(never_broadcast(chosen.select(*key, "step")), key)
    calm = _population(gated, F.col("raw"), *key).withColumnsRenamed({"maf": "raw_maf", "het": "raw_het"})
    after = _population(gated, F.col("reach") >= F.col("step"), *key)
    chosen = chosen.join(never_broadcast(calm), key, "left").join(never_broadcast(after), key, "left")
    many, site_rows = max(8, min(min_rows, 32)), max(6, min(16, min_rows))
    enough = F.col("n_labeled") >= F.when(F.col("level") < 2, min_rows).when(F.col("level") == 2, many).otherwise(site_rows)
    improves = F.col("own_objective") >= F.round(F.col("raw_objective") + min_improvement, 9)
    reasons = {
        "call_rate_above_bound": F.coalesce("rate", F.lit(1.0)) > high + 1e-6,
        "call_rate_below_bound": F.coalesce("rate", F.lit(1.0)) < low - 1e-6,
        "hardcall_het_shift_guard": F.abs(F.col("het") - F.col("raw_het")) > max_het_shift,
        "hardcall_maf_shift_guard": F.abs(F.col("maf") - F.col("raw_maf")) > max_maf_shift,
        "no_objective_improvement": ~improves,
        "no_threshold": F.col("score").isNull(),
        "nonfinite_objective": F.col("own_objective").isNull(),
    }
    why = F.array_join(F.array_compact(F.array(*[F.when(x, name) for name, x in reasons.items()])), ",")
    decided = chosen.withColumn("reason", F.when(enough, why).otherwise("insufficient_labels"))
    # written, so that its join below has plain exchanges: a row for each group of sites, as many as sites and more
    decided = written(decided.select(*key, "step", "n_labeled", "reason", (enough | (F.col("level") < 3)).alias("heard"), (F.col("own_objective") - F.col("raw_objective")).alias("gain")))
    own = of.join(never_broadcast(decided.where("heard")), key, "left").groupBy("pos", "site_index").agg(
        F.max_by(F.struct("level", "grp", "step", "gain"), F.when(F.col("reason") == "", F.col("level"))).alias("use"),
        F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("level"))).alias("reason"),
        F.max(F.when(F.col("reason") == "", 1).otherwise(0)).alias("accepted"),
    )
    own = own.withColumn("use", F.when(F.col("accepted") == 1, F.col("use")))
    cell = counts.join(never_broadcast(own.select("pos", F.col("use.step").alias("step"))), "pos").withColumn("kept", F.when(F.col("step").isNull(), F.col("raw")).otherwise(F.col("reach") >= F.col("step")))
    n = lambda c: F.when(c, F.col("n")).otherwise(0)
    site = cell.groupBy("pos").agg(
        F.sum("n").alias("cells"), F.sum(n(F.col("truth") >= 0)).alias("n_labeled"),
        *[F.sum(n(F.col(c)) * w).alias(f"{name}_{c}") for c in ("raw", "kept") for name, w in (("called", F.lit(1)), ("alt", F.col("pred")), ("het", (F.col("pred") == 1).cast("int")))],
    )
    mafs = {c: F.when(F.col(f"called_{c}") > 0, F.col(f"alt_{c}") / (2.0 * F.col(f"called_{c}"))) for c in ("raw", "kept")}
    mafs = {c: F.least(x, 1 - x) for c, x in mafs.items()}
    hets = {c: F.when(F.col(f"called_{c}") > 0, F.col(f"het_{c}") / F.col(f"called_{c}")) for c in ("raw", "kept")}
    site = site.select(
        "pos", "n_labeled", (F.col("called_raw") / F.col("cells")).alias("rate_raw"), (F.col("called_kept") / F.col("cells")).alias("rate_kept"),
        F.abs(mafs["raw"] - mafs["kept"]).alias("maf_shift"), F.abs(hets["raw"] - hets["kept"]).alias("het_shift"), F.col("called_raw").alias("called_raw"),
    )
    out = own.join(never_broadcast(site), "pos")
    delta = F.col("rate_kept") - F.col("rate_raw")
    guards = {
        "per_snp_call_rate_below_bound": delta < rate_delta[0] - 1e-6,
        "per_snp_call_rate_above_bound": delta > rate_delta[1] + 1e-6,
        "per_snp_maf_shift_guard": F.col("maf_shift") > max_maf_shift,
        "per_snp_het_shift_guard": F.col("het_shift") > max_het_shift,
    }
    guard = F.array_join(F.array_compact(F.array(*[F.when(F.col("use").isNotNull() & x, name) for name, x in guards.items()])), ",")
    out = out.withColumn("guard", guard).withColumn("ok", F.col("use").isNotNull() & (F.col("guard") == ""))
    ok = F.col("ok")
    name = F.get(F.array(*[F.lit(x) for x in LEVELS]), F.col("use.level"))
    source = F.when(F.col("use.level") == 0, name).otherwise(F.concat(name, F.lit(":"), F.col("use.grp")))
    reason = F.when(ok, "ok").when(F.col("guard") != "", F.col("guard")).otherwise(F.coalesce("reason", F.lit("not_evaluated")))
    same = F.when(F.col("called_raw") > 0, 0.0)
    return out.select(
        "pos", F.col("n_labeled").cast("long").alias("n_labeled"), ok.alias("calibration_used"), F.when(ok, source).otherwise("raw_no_call").alias("decision_source"), reason.alias("fallback_reason"),
        F.when(ok, F.get(steps, F.col("use.step") - 1)).otherwise(raw_threshold).alias("threshold"), F.col("rate_raw").alias("call_rate_raw"),
        F.when(ok, F.col("rate_kept")).otherwise(F.col("rate_raw")).alias("call_rate_calibrated"), F.when(ok, delta).otherwise(0.0).alias("call_rate_delta"),
        F.when(ok, F.col("use.gain")).alias("objective_delta"), F.when(ok, F.col("maf_shift")).otherwise(same).alias("maf_shift"), F.when(ok, F.col("het_shift")).otherwise(same).alias("het_shift"),
    )
