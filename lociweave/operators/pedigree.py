"""Pedigrees: edges, ancestry, kinship, and adjustment and checking of genotypes by relatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.operators.posterior import clipped
from lociweave.operators.relatedness import relationship
from lociweave.sources.scratch import forget, written

#: Texts that stand for no parent, after trimming and lower-casing.
MISSING = ("", "na", "nan", "n/a", "none", "null", "0")
#: Pairs of kin, or samples, that are broadcast (24 MB); more of them are joined by an exchange.
MOST_PAIRS = 1_000_000


def cleaned(x: Column) -> Column:
    """An id as text, null where it stands for none."""
    text = F.trim(x.cast("string"))
    return F.when(~F.lower(text).isin(*MISSING), text)


def edges(pedigree: DataFrame, samples: DataFrame) -> DataFrame:
    """(child, parent, role, known): one row per declared parent of a known child; known tells whether the parent is a sample."""
    rows = pedigree.select("child", F.explode(F.array(F.struct(F.lit("father").alias("role"), F.col("father").alias("parent")), F.struct(F.lit("mother").alias("role"), F.col("mother").alias("parent")))).alias("e"))
    rows = rows.select("child", "e.parent", "e.role").where("parent is not null")
    rows = rows.join(samples.select(F.col("sample_id").alias("child")), "child", "left_semi")
    parents = samples.select(F.col("sample_id").alias("parent"), F.lit(True).alias("known"))
    return rows.join(parents, "parent", "left").select("child", "parent", "role", F.coalesce("known", F.lit(False)).alias("known"))


def ancestry(edges_: DataFrame, samples: DataFrame, least: float = 1e-6, rounds: int = 64) -> DataFrame:
    """(id, ancestor, weight): the sum over paths of 0.5 per generation, each sample its own ancestor with weight 1.

    One join per generation; paths lighter than `least` end, so at most about 20 generations are followed. Each
    generation is written, so lineage stays short.
    """
    parents = edges_.where("known").select(F.col("child").alias("ancestor"), F.col("parent").alias("next"))
    level = samples.select(F.col("sample_id").alias("id"), F.col("sample_id").alias("ancestor"), F.lit(1.0).alias("weight"))
    all_levels = level
    for _ in range(rounds):
        level = level.join(parents, "ancestor").groupBy("id", F.col("next").alias("ancestor")).agg((F.sum("weight") * 0.5).alias("weight"))
        level = written(level.where(F.col("weight") >= least))
        if level.isEmpty():
            forget(level)
            break
        all_levels = all_levels.unionByName(level)
    return all_levels.groupBy("id", "ancestor").agg(F.sum("weight").alias("weight"))


def ordered(edges_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, step, on_cycle) of every node: steps from 0 in which all parents come before their children.

    edges_: child, parent (rows with a null end do not count, repeated ones once); nodes: id. A node's step is the longest way from a node without
    parents. Every round takes the nodes without an open parent, so there are as many rounds as generations. What is left has no
    step: the members of cycles, and their descendants; nodes without open children are taken off these until only cycles (and what lies
    between two of them) remain, which on_cycle marks.
    """
    open_ = written(edges_.where("child is not null and parent is not null").select("child", "parent").distinct())
    ends = open_.select(F.col("child").alias("id")).union(open_.select("parent"))
    left = written(nodes.select("id").where("id is not null").union(ends).distinct())
    placed, k = None, 0
    while True:
        free = written(left.join(open_.select(F.col("child").alias("id")).distinct(), "id", "left_anti").withColumn("step", F.lit(k)))
        if free.isEmpty():
            break
        placed = free if placed is None else placed.unionByName(free)
        left, open_, k = *_without(left, open_, free, "parent"), k + 1
    stuck, inner = left, left
    while True:
        free = written(inner.join(open_.select(F.col("parent").alias("id")).distinct(), "id", "left_anti"))
        if free.isEmpty():
            break
        inner, open_ = _without(inner, open_, free, "child", keep=stuck)
    rest = stuck.join(inner.withColumn("on_cycle", F.lit(True)), "id", "left").select("id", F.lit(None).cast("int").alias("step"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))
    return rest if placed is None else placed.withColumn("on_cycle", F.lit(False)).unionByName(rest)


def _without(left: DataFrame, open_: DataFrame, free: DataFrame, end: str, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the free nodes and the edges that end in them; the tables before are deleted, but for `keep`."""
    ids = free.select("id")
    nodes, edges_ = written(left.join(ids, "id", "left_anti")), written(open_.join(ids.withColumnRenamed("id", end), end, "left_anti").select("child", "parent"))
    if left is not keep:
        forget(left)
    forget(open_)
    return nodes, edges_


def kinship(ancestry_: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(a, b, kinship) for a <> b: half the summed products of ancestry weights, at least `threshold`."""
    x = ancestry_.select("ancestor", F.col("id").alias("a"), F.col("weight").alias("wa"))
    y = ancestry_.select("ancestor", F.col("id").alias("b"), F.col("weight").alias("wb"))
    out = x.join(y, "ancestor").where("a <> b").groupBy("a", "b").agg((F.sum(F.col("wa") * F.col("wb")) * 0.5).alias("kinship"))
    return out.where(F.col("kinship") >= threshold)


def smoothed(dosages: DataFrame, edges_: DataFrame, strength: float, compat: bool = True) -> DataFrame:
    """(1 - strength) * dosage + strength * mean of the parents' dosages. dosages: sample_id, pos, dosage.

    Without parents the mean counts as 0 with `compat`, which shrinks such samples; without it they stay as they are.
    """
    parents = edges_.where("known").select(F.col("child"), F.col("parent").alias("sample_id"))
    means = dosages.join(parents, "sample_id").groupBy(F.col("child").alias("sample_id"), "pos").agg(F.sum("dosage").alias("parent_sum"))
    degree = parents.groupBy(F.col("child").alias("sample_id")).agg(F.count(F.lit(1)).alias("degree"))
    rows = dosages.join(degree, "sample_id", "left").join(means, ["sample_id", "pos"], "left")
    mean = F.coalesce("parent_sum", F.lit(0.0)) / F.coalesce("degree", F.lit(1))
    value = (1 - strength) * F.col("dosage") + strength * mean
    if not compat:
        value = F.when(F.col("degree").isNull(), F.col("dosage")).otherwise(value)
    return rows.select("sample_id", "pos", value.alias("dosage"))


def evidence_weight(confidence: Column, supported: Column) -> Column:
    """0.05 + 0.95 * scaled confidence; at least 0.75 with reads, at most 0.15 without."""
    w = 0.05 + 0.95 * clipped((confidence - 1 / 3) / (2 / 3), 0.0, 1.0)
    return F.when(supported, F.greatest(w, F.lit(0.75))).otherwise(F.least(w, F.lit(0.15)))


def broadcast_if_few(rows: DataFrame) -> DataFrame:
    """rows about samples, written, to be broadcast in a join if they are at most MOST_PAIRS."""
    out = written(rows)
    return F.broadcast(out) if out.count() <= MOST_PAIRS else out.hint("merge")


def kinship_prior(cells: DataFrame, kin: DataFrame) -> DataFrame:
    """(sample_id, pos, prior, strength): relatives' dosages weighted by kinship and evidence. cells: sample_id, pos, dosage, weight.

    Cells are shuffled once, by site; with at most MOST_PAIRS pairs of kin, which are broadcast, what a cell says to its relatives then stays
    where the site is. With more pairs cells and kin meet by an exchange on the sample.
    """
    rel = broadcast_if_few(kin.select(F.col("a").alias("target"), F.col("b").alias("sample_id"), "kinship"))
    told = cells.select("sample_id", "pos", "dosage", "weight").repartition("pos").join(rel, "sample_id")
    w = F.col("kinship") * F.col("weight")
    out = told.groupBy(F.col("target").alias("sample_id"), "pos").agg(F.sum(w * F.col("dosage")).alias("s"), F.sum(w).alias("w"))
    return out.where("w > 1e-8").select("sample_id", "pos", (F.col("s") / F.col("w")).alias("prior"), clipped(F.col("w"), 0.0, 1.0).alias("strength"))


def child_distribution(q1: Column, q2: Column) -> Column:
    """Genotype probabilities of a child from its parents' chances to pass the alternative allele."""
    a, b = clipped(q1, 1e-5, 1 - 1e-5), clipped(q2, 1e-5, 1 - 1e-5)
    return F.array((1 - a) * (1 - b), a * (1 - b) + (1 - a) * b, a * b)


def transmission_prior(dosages: DataFrame, pedigree: DataFrame) -> DataFrame:
    """(sample_id, pos, p0, p1, p2): a child's genotype distribution from its parents where it has a dosage itself.

    A missing parent, or one without a dosage there, is the population.
    """
    q = dosages.select("sample_id", "pos", (F.col("dosage") / 2).alias("q"))
    population = dosages.groupBy("pos").agg((F.avg("dosage") / 2).alias("pop_q"))
    child = dosages.select(F.col("sample_id").alias("child"), "pos").join(pedigree, "child").join(population.select("pos", "pop_q"), "pos")
    child = child.join(q.select(F.col("sample_id").alias("father"), "pos", F.col("q").alias("q1")), ["father", "pos"], "left")
    child = child.join(q.select(F.col("sample_id").alias("mother"), "pos", F.col("q").alias("q2")), ["mother", "pos"], "left")
    dist = child_distribution(F.coalesce("q1", "pop_q"), F.coalesce("q2", "pop_q"))
    out = child.withColumn("d", dist)
    return out.select(F.col("child").alias("sample_id"), "pos", *[F.get("d", F.lit(g)).alias(f"p{g}") for g in range(3)])


def expected_relationship(pairs: DataFrame, pedigree: DataFrame) -> DataFrame:
    """pairs (a, b) with expected: parent_offspring, full_sib, half_sib, same_family or unrelated. pedigree: child, father, mother, family."""
    def side(name):
        return pedigree.select(F.col("child").alias(name), F.array_compact(F.array("father", "mother")).alias(f"parents_{name}"), F.col("family").alias(f"family_{name}"))

    rows = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    none = F.array().cast("array<bigint>")
    pa, pb = F.coalesce("parents_a", none), F.coalesce("parents_b", none)
    shared = F.size(F.array_intersect(pa, pb))
    out = (
        F.when(F.array_contains(pb, F.col("a")) | F.array_contains(pa, F.col("b")), "parent_offspring")
        .when(shared >= 2, "full_sib")
        .when(shared == 1, "half_sib")
        .when(F.col("family_a").isNotNull() & (F.col("family_a") == F.col("family_b")), "same_family")
        .otherwise("unrelated")
    )
    return rows.withColumn("expected", out).drop("parents_a", "parents_b", "family_a", "family_b")


def edge_status(edges_: DataFrame, r: DataFrame) -> DataFrame:
    """Declared edges with r, relationship call and status: removed, retained, inconclusive or no_evidence. r: a < b, r."""
    rows = edges_.withColumn("a", F.least("child", "parent")).withColumn("b", F.greatest("child", "parent")).join(r, ["a", "b"], "left").drop("a", "b")
    call = relationship(F.col("r"))
    status = (
        F.when(~F.col("known"), "no_evidence")
        .when(call.isin("unrelated", "same"), "removed")
        .when(call == "first_degree", "retained")
        .when(call == "inconclusive", "inconclusive")
        .otherwise("no_evidence")
    )
    return rows.withColumn("relationship_call", call).withColumn("edge_qc_status", status)


def sample_status(samples: DataFrame, status: DataFrame) -> DataFrame:
    """Per sample the removed and inconclusive parent edges and its status: corrected, review or pass."""
    n = status.groupBy(F.col("child").alias("sample_id")).agg(
        F.count_if(F.col("edge_qc_status") == "removed").alias("removed_parent_edges"),
        F.count_if(F.col("edge_qc_status") == "inconclusive").alias("inconclusive_parent_edges"),
    )
    out = samples.select("sample_id").join(n, "sample_id", "left").na.fill(0)
    verdict = F.when(F.col("removed_parent_edges") > 0, "corrected").when(F.col("inconclusive_parent_edges") > 0, "review").otherwise("pass")
    return out.withColumn("pedigree_qc_status", verdict)
