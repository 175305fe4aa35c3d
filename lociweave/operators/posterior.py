"""Algebra of genotype posteriors: arrays of ploidy + 1 probabilities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 1e-6


def clipped(x: Column, low: float, high: float) -> Column:
    """x held in [low, high]."""
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(a: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalised(gp: Column, floor: float = SMALL) -> Column:
    """gp with entries held in [floor, 1] and a sum of 1."""
    held = F.transform(gp, lambda x: clipped(x, floor, 1.0))
    return let(held, lambda h: let(total(h), lambda s: F.transform(h, lambda x: x / F.greatest(s, F.lit(1e-12)))))


def softmax(logits: Column) -> Column:
    """exp(x - max) over their sum."""
    def shares(e):
        return let(total(e), lambda s: F.transform(e, lambda x: x / s))

    return let(logits, lambda v: let(F.array_max(v), lambda top: let(F.transform(v, lambda x: F.exp(x - top)), shares)))


def from_dosage(dosage: Column, depth: Column | None = None, temperature: float = 0.35, ploidy: int = 2, floor: float = SMALL) -> Column:
    """Softmax of -(dosage - g)^2 / temperature, sharper with depth by sqrt(depth + 1)."""
    heat = F.lit(temperature) if depth is None else F.greatest(F.lit(SMALL), temperature / F.sqrt(F.greatest(depth, F.lit(0)) + 1.0))
    return normalised(softmax(F.array(*[-F.pow(dosage - g, F.lit(2.0)) / heat for g in range(ploidy + 1)])), floor)


def hardy_weinberg(dosage: Column) -> Column:
    """Genotype probabilities of a diploid with allele frequency dosage / 2."""
    return let(clipped(dosage / 2, 0.0, 1.0), lambda p: F.array((1 - p) * (1 - p), 2 * p * (1 - p), p * p))


def blended(raw: Column, other: Column, share: float, floor: float = SMALL) -> Column:
    """(1 - share) * raw + share * other, normalised."""
    return normalised(F.zip_with(raw, other, lambda a, b: (1 - share) * a + share * b), floor)


def modelled(rows: DataFrame, share: float, temperature: float = 0.35, floor: float = SMALL) -> DataFrame:
    """Diploid rows (dosage, depth) with raw, soft and gp: `hardy_weinberg`, `from_dosage` and the two `blended`.

    The same numbers from plain columns in steps, which Spark compiles and works out once, whatever is asked of the arrays later.
    """
    three = range(3)
    d, p, s = F.col("dosage"), F.col("_p"), F.col("_s")
    out = rows.withColumns({"_p": clipped(d / 2, 0.0, 1.0), "_heat": F.greatest(F.lit(SMALL), temperature / F.sqrt(F.greatest(F.col("depth"), F.lit(0)) + 1.0))})
    out = out.withColumns({f"_x{g}": -F.pow(d - g, F.lit(2.0)) / F.col("_heat") for g in three} | {"_r0": (1 - p) * (1 - p), "_r1": 2 * p * (1 - p), "_r2": p * p})
    out = out.withColumn("_s", F.greatest(*[f"_x{g}" for g in three])).withColumns({f"_x{g}": F.exp(F.col(f"_x{g}") - s) for g in three})
    out = out.withColumn("_s", F.col("_x0") + F.col("_x1") + F.col("_x2")).withColumns({f"_x{g}": F.col(f"_x{g}") / s for g in three})
    out = plainly_normalised(out, "_x", floor)
    out = out.withColumns({"raw": F.array("_r0", "_r1", "_r2"), "soft": F.array("_x0", "_x1", "_x2")} | {f"_x{g}": (1 - share) * F.col(f"_r{g}") + share * F.col(f"_x{g}") for g in three})
    return plainly_normalised(out, "_x", floor).withColumn("gp", F.array("_x0", "_x1", "_x2")).select(*rows.columns, "raw", "soft", "gp")


def plainly_normalised(rows: DataFrame, name: str, floor: float) -> DataFrame:
    """rows whose columns name0 to name2 are `normalised`."""
    names = [f"{name}{g}" for g in range(3)]
    held = rows.withColumns({n: clipped(F.col(n), floor, 1.0) for n in names}).withColumn("_s", F.col(names[0]) + F.col(names[1]) + F.col(names[2]))
    return held.withColumns({n: F.col(n) / F.greatest("_s", F.lit(1e-12)) for n in names}).drop("_s")


def dosage(gp: Column) -> Column:
    """Expected alternative alleles."""
    return F.aggregate(F.transform(gp, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)


def confidence(gp: Column) -> Column:
    return F.array_max(gp)


def margin(gp: Column) -> Column:
    """Largest minus second largest probability."""
    return let(F.sort_array(gp, False), lambda top: F.get(top, F.lit(0)) - F.get(top, F.lit(1)))


def entropy(gp: Column) -> Column:
    """Entropy over log of the number of classes."""
    def of(g):
        return total(F.transform(g, lambda x: -clipped(x, 1e-12, 1.0) * F.log(clipped(x, 1e-12, 1.0)))) / F.log(F.size(g).cast("double"))

    return let(gp, of)


def argmax(gp: Column) -> Column:
    """Index of the largest probability, the first on ties."""
    return let(gp, lambda g: (F.array_position(g, F.array_max(g)) - 1).cast("int"))


def call(gp: Column, min_confidence: float = 0.0, min_margin: float = 0.0, correct: Column | None = None, threshold: Column | float = 0.0) -> Column:
    """argmax where all gates are passed, else -1."""
    keep = (confidence(gp) >= min_confidence) & (margin(gp) >= min_margin)
    if correct is not None:
        keep = keep & (correct >= threshold)
    return F.when(keep, argmax(gp)).otherwise(-1)


def call_score(gp: Column, mode: str) -> Column:
    """A score of certainty: max_gp, log_max_gp, margin, neg_entropy or log_max_gp_minus_entropy."""
    log_max = F.log(clipped(confidence(gp), 1e-12, 1.0))
    modes = {
        "max_gp": confidence(gp),
        "log_max_gp": log_max,
        "margin": margin(gp),
        "neg_entropy": -entropy(gp),
        "log_max_gp_minus_entropy": log_max - entropy(gp),
    }
    if mode not in modes:
        raise ValueError(f"unknown call score {mode!r}: one of {', '.join(modes)}")
    return modes[mode]


def hwe_prior(alt_af: Column, floor: float = SMALL) -> Column:
    """Hardy-Weinberg genotype frequencies of an allele frequency, floored and normalised."""
    return let(clipped(alt_af, floor, 1 - floor), lambda p: normalised(F.array((1 - p) * (1 - p), 2 * p * (1 - p), p * p), floor))


def tilted(gp: Column, prior: Column, weight: float, floor: float = SMALL) -> Column:
    """gp * prior ** weight, normalised."""
    return normalised(
        F.zip_with(gp, prior, lambda g, q: F.exp(F.log(clipped(g, floor, 1.0)) + weight * F.log(clipped(q, floor, 1.0)))), floor
    )


def masked_by_ploidy(gp: Column, ploidy: Column) -> Column:
    """gp without genotypes beyond a sample's ploidy, normalised; null for ploidy 0 or less."""
    held = F.transform(gp, lambda x, i: F.when(i <= ploidy, x).otherwise(0.0))
    return F.when(ploidy > 0, let(held, lambda h: let(total(h), lambda s: F.transform(h, lambda x: x / F.greatest(s, F.lit(1e-12))))))


#: Coefficients of the rational approximation 7.1.26 of the error function (error below 1.5e-7).
_ERF_P = 0.3275911
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, by the rational approximation."""
    def of(t):
        poly = F.lit(_ERF[-1])
        for c in _ERF[-2::-1]:
            poly = c + t * poly
        return poly * t

    return let(1 / (1 + _ERF_P * x), of) * F.exp(-x * x)


def chi_square_p(x: Column) -> Column:
    """Chance of a chi-square value of x or more, one degree of freedom."""
    return erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2))


def normal_p(z: Column) -> Column:
    """Two-sided chance of a standard normal value as far out as z."""
    return erfc(F.abs(z) / F.sqrt(F.lit(2.0)))


def site_statistics(cells: DataFrame, ploidy: int = 2) -> DataFrame:
    """Per position: allele frequency, MAF, INFO, Hardy-Weinberg deviation and chi-square of diploid gp cells (pos, gp)."""
    ds = dosage(F.col("gp"))
    e2 = F.aggregate(F.transform("gp", lambda x, i: x * i * i), F.lit(0.0), lambda s, x: s + x)
    each = cells.select("pos", ds.alias("ds"), F.greatest(F.lit(0.0), e2 - ds * ds).alias("var"), *[F.get("gp", F.lit(g)).alias(f"g{g}") for g in range(3)])
    out = each.groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg("ds") / ploidy).alias("alt_af"),
        F.avg("var").alias("mean_var"),
        *[F.sum(f"g{g}").alias(f"s{g}") for g in range(3)],
    )
    af = F.col("alt_af")
    spread = ploidy * af * (1 - af)
    info = F.when(spread > 1e-8, clipped(1 - F.col("mean_var") / spread, -5.0, 1.0))
    n = F.greatest(F.lit(SMALL), F.col("s0") + F.col("s1") + F.col("s2"))
    prior = hwe_prior(clipped(af, SMALL, 1 - SMALL))
    expected = [F.get(prior, F.lit(g)) * n for g in range(3)]
    observed = [F.col(f"s{g}") for g in range(3)]
    chisq = sum(F.pow(o - e, F.lit(2.0)) / F.greatest(e, F.lit(SMALL)) for o, e in zip(observed, expected, strict=True))
    deviation = F.sqrt(sum(F.pow(o / n - e / n, F.lit(2.0)) for o, e in zip(observed, expected, strict=True)) / 3)
    return out.select(
        "pos", "n", "alt_af", F.least(af, 1 - af).alias("maf"), info.alias("info"), deviation.alias("hwe_deviation"), chisq.alias("hwe_chisq")
    )


def losses(cells: DataFrame, floor: float = SMALL) -> DataFrame:
    """One row: mean NLL, Brier score and dosage MSE of gp against truth, over cells with a truth."""
    seen = cells.where(F.col("truth").between(0, 2))
    p = F.get("gp", F.col("truth"))
    brier = total(F.transform("gp", lambda x, i: F.pow(x - F.when(i == F.col("truth"), 1.0).otherwise(0.0), F.lit(2.0)))) / 3
    return seen.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(-F.log(clipped(p, floor, 1.0))).alias("nll"),
        F.avg(brier).alias("brier"),
        F.avg(F.pow(dosage(F.col("gp")) - F.col("truth"), F.lit(2.0))).alias("dosage_mse"),
    )


def shifts(cells: DataFrame) -> DataFrame:
    """One row of mean differences between raw and calibrated posteriors (columns raw, gp)."""
    r, c = F.col("raw"), F.col("gp")
    sites = cells.groupBy("pos").agg((F.avg(dosage(r)) / 2).alias("raw_af"), (F.avg(dosage(c)) / 2).alias("cal_af"))
    maf = sites.agg(F.avg(F.abs(F.col("cal_af") - F.col("raw_af"))).alias("mean_abs_maf_shift"))
    cell = cells.agg(
        F.avg(F.abs(dosage(c) - dosage(r))).alias("mean_abs_dosage_shift"),
        (F.avg(entropy(c)) - F.avg(entropy(r))).alias("mean_entropy_shift"),
        F.avg(F.abs(entropy(c) - entropy(r))).alias("mean_abs_entropy_shift"),
        (F.avg(F.get(c, F.lit(1))) - F.avg(F.get(r, F.lit(1)))).alias("het_rate_shift"),
    )
    return cell.join(maf)
