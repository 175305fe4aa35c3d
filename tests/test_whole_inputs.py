"""Queries against brute force over all rows that they are given, none left out."""

from collections import Counter, defaultdict

import numpy as np

from lociweave.plans import catalogue, site_queries


def test_loco_grm_takes_every_vector(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.3, (7, 12))
    rows = [(i, i % 2, [float(v) for v in x[i]]) for i in range(7)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = np.clip(1 + x, 0, 2)
    z = (d - d.mean(0)) / d.std(0)
    want = {}
    for chrom in range(4):
        rest = np.arange(12) % 4 != chrom
        for a in range(7):
            want[a, chrom] = (np.mean([z[a, rest] @ z[b, rest] / rest.sum() for b in range(a, 7)]), 7 - a)
    got = {(r.a, r.chrom): (r.mean_loco, r.n_pairs) for r in catalogue.QUERIES["q_loco_grm"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    for k, (mean, n) in want.items():
        assert got[k][1] == n and abs(got[k][0] - mean) < 2e-6


def array_genotypes(duck):
    """(vector, position): genotype of every value of every vector."""
    rows = duck.execute("select vec_id, embedding from embeddings").fetchall()
    x = np.clip(1 + np.array([r[1] for r in rows], float), 0, 2)
    g = np.rint(np.clip(1 + 8 * (x - 1), 0, 2)).astype(int)
    return {(r[0], 2 * v + 1): int(g[i, v]) for i, r in enumerate(rows) for v in range(g.shape[1])}


def test_microarray_takes_every_vector(spark, folder, duck):
    array = array_genotypes(duck)
    seen = {(r.sample_id, r.pos): (r.ref_count, r.alt_count) for r in catalogue.QUERIES["q_evidence_counts"](spark, folder).collect()}
    want = {}
    for k in array.keys() | seen.keys():
        more = {0: (20, 0), 1: (10, 10), 2: (0, 20)}.get(array.get(k), (0, 0))
        want[k] = tuple(min(65535, n + m) for n, m in zip(seen.get(k, (0, 0)), more))
    got = {(r.sample_id, r.pos): (r.ref_count, r.alt_count) for r in catalogue.QUERIES["q_microarray_inject"](spark, folder).collect()}
    assert got == want
    samples = {r[0] for r in duck.execute("select n_nationkey from nation").fetchall()}
    ids = {k[0] for k in array}
    aligned = catalogue.QUERIES["q_microarray_align"](spark, folder).collect()
    assert len(aligned) == len(samples | ids) and {r.sample_id: r.has_array for r in aligned} == {i: i in ids for i in samples | ids}


def test_indel_discovery_takes_every_site(spark, folder):
    events, strands, samples = Counter(), Counter(), defaultdict(set)
    for r in site_queries._bases(spark, folder).where("code = 1").collect():
        both = r.ref + r.base
        k = (r.chrom, r.pos, r.ref, both) if r.pos % 3 == 0 else (r.chrom, r.pos, both, r.ref)
        events[k] += 1
        strands[k] += r.strand == "+"
        samples[k].add(r.sample_id)
    want = {(*k, n, len(samples[k]), strands[k], n - strands[k], "insertion" if k[1] % 3 == 0 else "deletion") for k, n in events.items() if n >= 2}
    out = catalogue.QUERIES["q_indel_discovery"](spark, folder)
    assert out.columns == ["chrom", "pos", "ref", "alt", "alt_count", "sample_support", "alt_forward_count", "alt_reverse_count", "variant_type"]
    assert {tuple(r) for r in out.collect()} == want and {k[1] % 3 for k in want} == {0, 1, 2}
