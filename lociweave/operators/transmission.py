"""Adjustment of genotype posteriors by messages between parents and children.

cells: sample_id, chrom, pos, gp (three probabilities), supported (whether reads or arrays speak for the cell). A site is named
by pos, so all cells there have one chrom; cells with a null in any of these take no part. A cell that a relative lacks is filled by the population there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.operators import posterior as gp_
from lociweave.operators.pedigree import ancestry, broadcast_if_few, child_distribution, edges, evidence_weight, kinship, kinship_prior, smoothed
from lociweave.sources.scratch import forget, written

#: Fixed values of the method.
FLOOR = 1e-8
SMOOTH_SHARE = 0.15
ANCHORED = 0.30
MOST_BLEND = 0.85
KINSHIP_SHARE = 0.15
#: exp of more than this is no double any more.
LARGEST_EXPONENT = 700.0


def recombination_smoothed(values: DataFrame, generations: DataFrame | None = None, rate: float = 1e-8) -> DataFrame:
    """`values` with `smoothed`: the mean of a forward and a backward moving average along each sample's chromosome.

    values: sample_id, chrom, pos, value and any other columns; generations: sample_id, generation (10 where unknown). Between
    neighbours an average keeps the share exp(-generation * distance * rate). Such a recurrence has a closed form, a running sum
    of exp(u) differences times the values, scaled by exp(-u), so two windows do it and no chromosome is gathered in a row.
    Rows with a null value or place go; rows at the same place are taken in the order of their values. Fails where
    generation * length * rate of a chromosome is beyond 700.
    """
    # a filter on the value would be pushed down into all that made it, where its expression is repeated for each use: rows without one are not made
    rows = values.where("pos is not null").withColumn("value", F.explode(F.when(F.col("value").isNotNull(), F.array("value"))))
    if generations is None:
        rows = rows.withColumn("_rate", F.lit(10.0 * rate))
    else:
        known = generations.groupBy("sample_id").agg(F.max("generation").alias("_rate"))
        rows = rows.join(known, "sample_id", "left").withColumn("_rate", F.greatest(F.coalesce("_rate", F.lit(10.0)), F.lit(0.0)) * rate)
    track = Window.partitionBy("sample_id", "chrom")
    span = F.col("_rate") * (F.max("pos").over(track) - F.min("pos").over(track))
    rows = rows.withColumn("_span", F.when(span > LARGEST_EXPONENT, F.raise_error(F.lit("generation * length * rate is beyond 700"))).otherwise(span))
    rows = rows.withColumn("_ahead", F.col("_rate") * (F.col("pos") - F.min("pos").over(track))).withColumn("_behind", F.col("_span") - F.col("_ahead"))

    def average(u: str, order) -> Column:
        before = F.lag(u).over(order)
        share = F.coalesce(F.exp(before) * F.expm1(F.col(u) - before), F.lit(1.0))
        return share * F.col("value")

    forward, backward = track.orderBy("pos", "value"), track.orderBy(F.desc("pos"), F.desc("value"))
    rows = rows.withColumn("_f", average("_ahead", forward)).withColumn("_b", average("_behind", backward))
    upto = Window.unboundedPreceding, Window.currentRow
    mean = 0.5 * (
        F.exp(-F.col("_ahead")) * F.sum("_f").over(forward.rowsBetween(*upto)) + F.exp(-F.col("_behind")) * F.sum("_b").over(backward.rowsBetween(*upto))
    )
    return rows.withColumn("smoothed", gp_.clipped(mean, 0.0, 1.0)).drop("_rate", "_span", "_ahead", "_behind", "_f", "_b")


def _split(rows: DataFrame) -> DataFrame:
    """rows with g0 to g2, the normalised gp, instead of gp."""
    return gp_.plainly_normalised(rows.withColumns({f"g{g}": F.get("gp", F.lit(g)) for g in range(3)}).drop("gp"), "g", FLOOR)


def _blended(rows: DataFrame, into: str, other: str, share: Column) -> DataFrame:
    """rows whose three columns `into` move towards the columns `other` by `share`."""
    mixed = rows.withColumn("_share", share)
    mixed = mixed.withColumns({f"{into}{g}": (1 - F.col("_share")) * F.col(f"{into}{g}") + F.col("_share") * F.col(f"{other}{g}") for g in range(3)})
    return gp_.plainly_normalised(mixed.drop("_share"), into, FLOOR)


def _dosage() -> Column:
    return F.col("g1") + 2 * F.col("g2")


def _prepared(cells: DataFrame) -> DataFrame:
    """Whole cells as g0 to g2 instead of gp, and their weight: plain columns, which Spark compiles."""
    rows = _split(cells.where("sample_id is not null and pos is not null and gp is not null and supported is not null"))
    return plainly_weighed(rows, "weight")


def plainly_weighed(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn(name, evidence_weight(F.greatest("g0", "g1", "g2"), F.col("supported")))


def kinship_adjusted(cells: DataFrame, kin: DataFrame, strength: float = 0.5) -> DataFrame:
    """`cells` whose gp moves towards the dosages of relatives, by `strength` times what evidence the relatives have. kin: a, b, kinship."""
    rows = _prepared(cells)
    prior = kinship_prior(rows.select("sample_id", "pos", _dosage().alias("dosage"), "weight"), kin)
    prior = prior.select("sample_id", "pos", F.col("prior").alias("_prior"), F.col("strength").alias("_strength"))
    rows = _towards_prior(rows.drop("weight").join(prior, ["sample_id", "pos"], "left"), strength)
    return rows.withColumn("gp", F.array("g0", "g1", "g2")).select(*cells.columns)


def _towards_prior(rows: DataFrame, strength: float) -> DataFrame:
    """g0 to g2 moved towards _prior, a dosage, by `strength` times _strength; nulls say nothing."""
    rows = rows.withColumns({"_own": _dosage(), "_blend": F.coalesce(gp_.clipped(F.when(F.col("_prior").isNotNull(), F.col("_strength")) * strength, 0.0, 1.0), F.lit(0.0))})
    rows = rows.withColumn("_d", gp_.clipped((1 - F.col("_blend")) * F.col("_own") + F.col("_blend") * F.coalesce("_prior", "_own"), 0.0, 2.0))
    # a softmax; one of the three is at most half away, so without taking their top off
    rows = rows.withColumns({f"_e{g}": F.exp(-(F.col("_d") - g) * (F.col("_d") - g) / 0.25) for g in range(3)}).withColumn("_sum", F.col("_e0") + F.col("_e1") + F.col("_e2"))
    return _blended(rows.withColumns({f"_e{g}": F.col(f"_e{g}") / F.col("_sum") for g in range(3)}), "g", "_e", F.col("_blend"))


def _towards_kin(rows: DataFrame, kin: DataFrame, strength: float) -> DataFrame:
    """`kinship_adjusted` of rows with g0 to g2 in place: what a cell tells its kin stays with its site. kin: sample_id, to (target, kinship)."""
    names = [c for c in rows.columns if c not in ("sample_id", "chrom", "pos")]
    rows = plainly_weighed(gp_.plainly_normalised(rows, "g", FLOOR), "_w").withColumn("_own", _dosage())
    me = F.array(F.struct(F.col("sample_id").alias("target"), F.lit(None).cast("double").alias("kinship")))
    told = rows.join(kin, "sample_id", "left").withColumn("e", F.explode(F.concat(me, F.coalesce("to", F.array().cast("array<struct<target:bigint,kinship:double>>")))))
    own, w = F.col("e.kinship").isNull(), F.col("e.kinship") * F.col("_w")
    met = told.groupBy(F.col("e.target").alias("sample_id"), "pos", "chrom").agg(
        *[F.max(F.when(own, F.col(c))).alias(c) for c in names], F.sum(w * F.col("_own")).alias("_s"), F.sum(w).alias("_strength")
    ).where("g0 is not null")
    met = met.withColumn("_prior", F.when(F.col("_strength") > 1e-8, F.col("_s") / F.col("_strength"))).withColumn("_strength", gp_.clipped(F.col("_strength"), 0.0, 1.0))
    return _towards_prior(met, strength)


def _likelihood(rows: DataFrame, name: str, other: str) -> DataFrame:
    """rows with name0 to name2: how well each genotype of one parent explains the child's gp when the other parent passes the alternative with chance `other`."""
    z = F.col(other)
    each = [[gp_.clipped(F.lit(g / 2), 1e-5, 1 - 1e-5), gp_.clipped(z, 1e-5, 1 - 1e-5)] for g in range(3)]
    told = {f"{name}{g}": F.col("g0") * ((1 - a) * (1 - b)) + F.col("g1") * (a * (1 - b) + (1 - a) * b) + F.col("g2") * (a * b) for g, (a, b) in enumerate(each)}
    return gp_.plainly_normalised(rows.withColumns(told), name, FLOOR)


_STATE = ("supported", "g0", "g1", "g2", "weight", "pop_q")


def _messages(q: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """The state of every cell of q with n and m0 to m2: the product of what its parents and children say.

    Cells are shuffled once, by site. There a cell tells its children its chance; a child, its parents' and the population's chances meet in
    one row, which sends up to three messages, added as logarithms. parents: child, father, mother; children: sample_id, to (target, role).
    """
    me = F.array(F.struct(F.col("sample_id").alias("target"), F.lit(0).alias("role")))
    told = q.repartition("pos").join(children, "sample_id", "left").withColumn("e", F.explode(F.concat(me, F.coalesce("to", F.array().cast("array<struct<target:bigint,role:int>>")))))
    role = F.col("e.role")
    trio = told.groupBy(F.col("e.target").alias("child"), "pos", "chrom").agg(
        *[F.max(F.when(role == 0, F.col(c))).alias(c) for c in _STATE], *[F.max(F.when(role == i + 1, F.col("q"))).alias(f"q_{who}") for i, who in enumerate(("father", "mother"))]
    ).where("g0 is not null")
    trio = trio.join(parents, "child", "left").withColumns({"a": F.coalesce("q_father", "pop_q"), "b": F.coalesce("q_mother", "pop_q")})
    trio = trio.withColumns({f"c{g}": F.get(child_distribution(F.col("a"), F.col("b")), F.lit(g)) for g in range(3)})
    trio = _likelihood(_likelihood(trio, "f", "b"), "m", "a")
    heard = F.col("q_father").isNotNull() | F.col("q_mother").isNotNull()

    def to(who: Column, own: bool, said: Column, name: str) -> Column:
        return F.struct(who.alias("sample_id"), F.lit(own).alias("own"), *[F.when(said, F.log(f"{name}{g}")).alias(f"l{g}") for g in range(3)])

    sent = F.array(
        to(F.col("child"), True, heard, "c"),
        to(F.when(F.col("q_father").isNotNull(), F.col("father")), False, F.lit(True), "f"),
        to(F.when(F.col("q_mother").isNotNull(), F.col("mother")), False, F.lit(True), "m"),
    )
    rows = trio.select("pos", "chrom", *_STATE, F.explode(sent).alias("s")).where("s.sample_id is not null")
    out = rows.groupBy(F.col("s.sample_id").alias("sample_id"), "pos", "chrom").agg(
        *[F.max(F.when(F.col("s.own"), F.col(c))).alias(c) for c in _STATE], F.count("s.l0").alias("n"), *[F.exp(F.sum(f"s.l{g}")).alias(f"m{g}") for g in range(3)]
    )
    return gp_.plainly_normalised(out, "m", FLOOR)


def parents_of(pedigree: DataFrame) -> DataFrame:
    """(child, father, mother), one row per child: the smallest of repeated rows; a parent named twice counts once."""
    one = pedigree.where("child is not null").groupBy("child").agg(F.min(F.struct("father", "mother")).alias("p")).select("child", "p.father", "p.mother")
    return one.withColumn("mother", F.when(~F.col("mother").eqNullSafe(F.col("father")), F.col("mother")))


def transmission_adjusted(
    cells: DataFrame, pedigree: DataFrame, kin: DataFrame, generations: DataFrame | None = None, strength: float = 0.7, iterations: int = 4, rate: float = 1e-8
) -> DataFrame:
    """(sample_id, chrom, pos, supported, gp) after rounds of messages down and up the pedigree, and a last step towards kin.

    pedigree: child, father, mother; kin: a, b, kinship. Each round smooths the chances along the chromosome, takes the product
    of all messages of a cell (floored at 1e-8, so very many children say nothing more) and blends it in, less where the cell has
    evidence and for samples with any supported cell. Each round's state is written, so lineage stays short.
    """
    parents = parents_of(pedigree)
    roles = F.array(*[F.struct(F.col(who).alias("sample_id"), F.lit(i + 1).alias("role")) for i, who in enumerate(("father", "mother"))])
    children = parents.select(F.col("child").cast("long").alias("child"), F.explode(roles).alias("e")).where("e.sample_id is not null")
    children = broadcast_if_few(children.groupBy("e.sample_id").agg(F.collect_list(F.struct(F.col("child").alias("target"), "e.role")).alias("to")))
    parents = broadcast_if_few(parents)
    names = ["sample_id", "chrom", "pos", *_STATE]
    base = _prepared(cells.select("sample_id", "chrom", "pos", "supported", "gp"))
    now = written(base.withColumn("pop_q", F.avg(_dosage()).over(Window.partitionBy("pos")) / 2).select(*names))
    direct = broadcast_if_few(now.groupBy("sample_id").agg(F.when(F.max("supported"), ANCHORED).otherwise(1.0).alias("anchor")))
    # the last round goes on to kin where its sites are
    rounds = max(iterations, 1)
    for k in range(rounds):
        q = recombination_smoothed(now.withColumn("value", _dosage() / 2), generations, rate)
        q = q.withColumn("q", gp_.clipped((1 - SMOOTH_SHARE) * F.col("value") + SMOOTH_SHARE * F.col("smoothed"), 0.0, 1.0)).drop("value", "smoothed")
        rows = _messages(q, parents, children).join(direct, "sample_id")
        blend = gp_.clipped(strength * F.col("anchor") * F.col("n") / (F.col("n") + 2.0) * (1 - F.col("weight")), 0.0, MOST_BLEND)
        rows = _blended(rows.withColumns({f"was{g}": F.col(f"g{g}") for g in range(3)}), "g", "m", blend)
        rows = rows.withColumns({f"g{g}": F.when(F.col("n") == 0, F.col(f"was{g}")).otherwise(F.col(f"g{g}")) for g in range(3)})
        if k < rounds - 1:
            before, now = now, written(rows.select(*names))
            forget(before)
    related = rows.select(*names).withColumns({f"was{g}": F.col(f"g{g}") for g in range(3)})
    related = _towards_kin(related, broadcast_if_few(kin.groupBy(F.col("b").alias("sample_id")).agg(F.collect_list(F.struct(F.col("a").alias("target"), "kinship")).alias("to"))), min(strength, 0.35))
    related = _blended(related, "was", "g", KINSHIP_SHARE * (1 - F.col("weight")))
    return related.select("sample_id", "chrom", "pos", "supported", F.array("was0", "was1", "was2").alias("gp"))


def adjusted(cells: DataFrame, pedigree: DataFrame, samples: DataFrame, mode: str, strength: float, ploidy: int = 2, **more) -> DataFrame:
    """(sample_id, pos, dosage, mode) by mode off, smooth, kinship or transmission; other ploidies than two are smoothed instead.

    The mode told is the one applied: off also without strength, smooth_fallback for those other ploidies.
    """
    if mode not in ("off", "smooth", "kinship", "transmission"):
        raise ValueError(f"unknown pedigree mode {mode!r}")
    plain = cells.where("gp is not null").select("sample_id", "pos", gp_.dosage(F.col("gp")).alias("dosage"))
    if mode == "off" or strength <= 0:
        return plain.withColumn("mode", F.lit("off"))
    linked = edges(pedigree, samples)
    if mode == "smooth" or ploidy != 2:
        return smoothed(plain, linked, strength).withColumn("mode", F.lit("smooth" if mode == "smooth" else "smooth_fallback"))
    kin = kinship(ancestry(linked, samples))
    out = kinship_adjusted(cells, kin, strength) if mode == "kinship" else transmission_adjusted(cells, pedigree, kin, strength=strength, **more)
    return out.select("sample_id", "pos", gp_.dosage(F.col("gp")).alias("dosage"), F.lit(mode).alias("mode"))
