"""Hand-made cases with exact answers."""

import math

import pytest
from pyspark.sql import functions as F

from lociweave.plans import domain
from lociweave.operators import evidence, founders, hmm, pedigree, posterior, relatedness, sites
from lociweave.operators.components import components


def one(df):
    return df.first()


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(*x):
    return F.array(*[F.lit(float(v)) for v in x])


@pytest.mark.parametrize("q, want", [(10, 0.9), (20, 0.99)])
def test_base_weight(spark, q, want):
    assert value(spark, evidence.weight(F.lit(q))) == pytest.approx(want)


@pytest.mark.parametrize("ref, alt, want", [("A", "G", "snp"), ("A", "AT", "insertion"), ("AT", "A", "deletion"), ("A", "A,T", "invalid"), ("A", ".", "invalid"), ("AT", "GC", "invalid")])
def test_variant_type(spark, ref, alt, want):
    assert value(spark, sites.variant_type(F.lit(ref), F.lit(alt))) == want


def test_variant_type_of_null_is_invalid(spark):
    assert value(spark, sites.variant_type(F.lit(None).cast("string"), F.lit("A"))) == "invalid"


def test_fragment_compression_and_centre(spark):
    rows = spark.createDataFrame([(1, 1, 5, 0, 10, 1.0), (1, 1, 5, 1, 30, 2.0), (1, 1, 7, 0, 20, 3.0)], "sample_id long, fragment long, pos long, code int, qual int, ord double")
    assert sorted((r.pos, r.qual) for r in evidence.compressed(rows).collect()) == [(5, 30), (7, 20)]
    far = spark.createDataFrame([(1, 1, p) for p in (100, 110, 200)], "sample_id long, fragment long, pos long")
    assert one(evidence.centres(far)).center == 110


@pytest.mark.parametrize("ref, alt, want", [(3, 0, 0), (2, 2, 1), (0, 3, 2), (1, 1, -1)])
def test_truth_label(spark, ref, alt, want):
    rows = spark.createDataFrame([(ref, alt, 0)], "ref_count long, alt_count long, other_count long")
    assert one(evidence.truth_labels(rows)).truth == want


def test_info_score(spark):
    hard = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (1, [0.0, 0.0, 1.0])], "pos long, gp array<double>")
    assert one(posterior.site_statistics(hard)).info == pytest.approx(1.0)
    even = spark.createDataFrame([(1, [1 / 3] * 3)], "pos long, gp array<double>")
    assert one(posterior.site_statistics(even)).info == pytest.approx(-1 / 3)


def test_confidence_measures(spark):
    g = array(0.7, 0.2, 0.1)
    assert value(spark, posterior.margin(g)) == pytest.approx(0.5)
    assert value(spark, posterior.entropy(g)) == pytest.approx(0.7298, abs=1e-4)
    assert value(spark, posterior.call(g, 0.8)) == -1
    assert value(spark, posterior.argmax(array(0.4, 0.4, 0.2))) == 0


def test_unknown_call_score_is_an_error():
    with pytest.raises(ValueError, match="unknown call score"):
        posterior.call_score(F.col("gp"), "best")


def test_recombination_and_switch(spark):
    rows = spark.createDataFrame([("1", 0, 0.0), ("1", 1_000_000, 1.0)], "chrom string, pos long, cm double")
    assert [r.rate for r in sites.recombination(rows).orderBy("pos").collect()] == pytest.approx([1e-10, 0.01])
    assert value(spark, sites.switch_probability(F.lit(0.01), F.lit(10.0))) == pytest.approx(1 - math.exp(-0.1))


def test_kinship_of_parent_and_child(spark):
    edges = spark.createDataFrame([(3, 1, "father", True), (3, 2, "mother", True)], "child long, parent long, role string, known boolean")
    samples = spark.createDataFrame([(1,), (2,), (3,)], "sample_id long")
    got = {(r.a, r.b): r.kinship for r in pedigree.kinship(pedigree.ancestry(edges, samples)).collect()}
    assert got == {(1, 3): 0.25, (3, 1): 0.25, (2, 3): 0.25, (3, 2): 0.25}


def test_king_of_equal_heterozygotes(spark):
    rows = spark.createDataFrame([(i, v, 1) for i in (1, 2) for v in range(4)], "id long, variant int, genotype int")
    assert one(relatedness.king(rows)).kinship == 0.5


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (51, 51), (51, None), (50, 51)], "a long, b long")
    got = {r.node: r.component_id for r in components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 51: 50}
    assert components(chain.limit(0)).count() == 0


def test_pedigree_order_with_cycles(spark):
    edges = [(3, 1), (3, 2), (4, 3), (4, 1), (5, 4), (5, 4), (10, 12), (11, 10), (12, 11), (13, 12), (14, 13), (10, 9), (20, 20), (7, None)]
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 6)], "id long")
    out = {r.id: (r.step, r.on_cycle) for r in pedigree.ordered(spark.createDataFrame(edges, "child long, parent long"), nodes).collect()}
    steps = {1: 0, 2: 0, 6: 0, 9: 0, 3: 1, 4: 2, 5: 3}
    assert out == {**{i: (s, False) for i, s in steps.items()}, **{i: (None, True) for i in (10, 11, 12, 20)}, 13: (None, False), 14: (None, False)}
    assert pedigree.ordered(spark.createDataFrame([], "child long, parent long"), nodes.limit(0)).count() == 0


def test_unknown_coupling_mode_is_an_error(spark):
    none = spark.createDataFrame([], "sample_id long, pos long, founder long, log_emission double, fragment long, scaled double, center long")
    with pytest.raises(ValueError, match="unknown coupling mode"):
        hmm.coupled(none, none, none, "both")


def test_em_moves_only_mutable_founders(spark):
    pos = spark.createDataFrame([("1", p, p * 0.1) for p in range(1, 6)], "chrom string, pos long, cm double")
    samples = spark.createDataFrame([(s, 10.0) for s in range(4)], "sample_id long, generation double")
    panel = spark.createDataFrame([(p, f, 0.05 if f == 0 else 0.5, int(f == 0)) for p in range(1, 6) for f in range(3)], "pos long, founder long, alt_prob double, immutable int")
    seen = spark.createDataFrame([(s, p, 0.0, 3.0, 0.0) for s in range(4) for p in range(1, 6)], "sample_id long, pos long, ref_weight double, alt_weight double, other_weight double")
    out, deltas = founders.learn_founders(seen, pos, samples, panel, rounds=2)
    got = {(r.pos, r.founder): r.alt_prob for r in out.collect()}
    assert all(got[p, 0] == 0.05 for p in range(1, 6)) and all(got[p, 1] > 0.6 for p in range(1, 6)) and len(deltas) == 2


def test_permutations_keep_the_values(spark):
    traits = spark.createDataFrame([(i, "t", float(i * i)) for i in range(20)], "id long, trait string, value double")
    out = relatedness.permuted(traits, 3).collect()
    assert len(out) == 60
    for r in (1, 2, 3):
        assert sorted(x.value for x in out if x.replicate == r) == [float(i * i) for i in range(20)]
    assert [x.value for x in sorted(out, key=lambda x: (x.replicate, x.id))][:20] != [float(i * i) for i in range(20)]


@pytest.mark.parametrize("z", [0.0, 0.5, 1.96, 4.0])
def test_normal_p_value(spark, z):
    assert value(spark, posterior.normal_p(F.lit(z))) == pytest.approx(math.erfc(z / math.sqrt(2)), abs=2e-7)


@pytest.mark.parametrize("mode", ["replace", "augment"])
def test_coupled_cells_are_dealt_out_once(spark, folder, mode):
    """Cells were shuffled twice and fragments three times by founder: F10 q_coupling_replace, F11 q_coupling_augment."""
    observed, panel = evidence.usable(domain.reads(spark, folder)), domain.founders(spark, folder)
    fragments, cells = evidence.compressed(observed), evidence.evidence_counts(observed)
    told = hmm.fragment_likelihoods(fragments, panel), evidence.centres(fragments), mode
    got = hmm.coupled_evidence(cells, panel, *told)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "founder#" in x]
    want = {r[:3]: r[3] for r in hmm.coupled(hmm.haploid_emissions(cells, panel), *told).collect()}
    rows = got.collect()
    assert len(rows) == len(want) and all(abs(want[r[:3]] - r[3]) < 1e-9 for r in rows)
