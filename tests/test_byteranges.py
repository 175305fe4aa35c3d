"""Genotype sets and relationship matrices over several byte ranges, there and back."""

import numpy as np
import pytest

from lociweave.operators import sinks
from lociweave.sources import byteranges, formats


@pytest.fixture
def small_ranges(monkeypatch):
    """Ranges of 24 bytes, so that small files have many of them."""
    monkeypatch.setattr(byteranges, "RANGE_BYTES", 24)


def made_set(spark, n=7, m=41):
    rng = np.random.default_rng(4)
    g = rng.integers(-1, 3, (m, n))
    g[17] = -1
    cells = [(v, s, None if g[v, s] < 0 else float(g[v, s])) for v in range(m) for s in range(n) if v != 17]
    dosages = spark.createDataFrame(cells, "variant_index long, sample_index long, dosage double")
    samples = spark.createDataFrame([(s, "f", f"i{s}", None, None, 1, -9) for s in range(n)], "sample_index long, fid string, iid string, father string, mother string, sex int, pheno int")
    variants = spark.createDataFrame([(v, "1" if v < 30 else "2", f"s{v}", v / 8, 10 * v, "A", "G") for v in range(m)], "variant_index long, chrom string, snp string, cm double, pos long, a1 string, a2 string")
    return g, dosages, samples, variants


def test_genotype_set_and_back(spark, tmp_path, small_ranges):
    g, dosages, samples, variants = made_set(spark)
    prefix = str(tmp_path / "set")
    sinks.write_genotype_set(dosages, samples, variants, prefix)
    assert (tmp_path / "set.bed").stat().st_size == 3 + 41 * 2
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["set.bed", "set.bim", "set.fam"]
    rows = formats.bed(spark, f"{prefix}.bed", 7)
    assert rows.rdd.getNumPartitions() == 4
    got = {(r.variant_index, r.sample_index): r.genotype for r in rows.collect()}
    assert got == {(v, s): None if g[v, s] < 0 else g[v, s] for v in range(41) for s in range(7)}
    assert [r.snp for r in formats.bim(spark, f"{prefix}.bim").orderBy("variant_index").collect()] == [f"s{v}" for v in range(41)]
    assert [(r.iid, r.father) for r in formats.fam(spark, f"{prefix}.fam").orderBy("sample_index").collect()] == [(f"i{s}", "0") for s in range(7)]


def test_only_asked_variants_are_read(spark, tmp_path, small_ranges):
    g, dosages, samples, variants = made_set(spark)
    prefix = str(tmp_path / "set")
    sinks.write_genotype_set(dosages, samples, variants, prefix)
    asked = spark.createDataFrame([("chr1", 50), ("chr1", 50), ("1", 290), ("2", 400), ("2", 50), (None, 60)], "chrom string, pos long")
    got = {(r.pos, r.iid): r.genotype for r in formats.bed_at(spark, prefix, asked).collect()}
    assert got == {(10 * v, f"i{s}"): None if g[v, s] < 0 else g[v, s] for v in (5, 29, 40) for s in range(7)}
    assert formats.bed_at(spark, prefix, asked.limit(0)).count() == 0


def test_relationships_and_back(spark, tmp_path, small_ranges):
    n = 9
    rng = np.random.default_rng(6)
    k = rng.normal(size=(n, n)).astype("f4")
    pairs = spark.createDataFrame([(j, i, float(k[i, j]), 100.0 + i) for i in range(n) for j in range(i + 1) if (i, j) != (4, 2)], "i long, j long, value double, n double")
    ids = spark.createDataFrame([(i, "f", f"i{i}") for i in range(n)], "at long, fid string, iid string")
    prefix = str(tmp_path / "k")
    sinks.write_grm(pairs, ids, prefix)
    got = {(r.iid_i, r.iid_j): (r.value, r.n) for r in formats.grm(spark, prefix).collect()}
    want = {(f"i{i}", f"i{j}"): (float(k[i, j]), 100.0 + i) if (i, j) != (4, 2) else (0.0, 0.0) for i in range(n) for j in range(i + 1)}
    assert got == want
    (tmp_path / "k.grm.N.bin").unlink()
    assert {r.n for r in formats.grm(spark, prefix).collect()} == {None}


def test_no_variants(spark, tmp_path):
    _, dosages, samples, variants = made_set(spark)
    prefix = str(tmp_path / "none")
    sinks.write_genotype_set(dosages.limit(0), samples, variants.limit(0), prefix)
    assert formats.bed(spark, f"{prefix}.bed", 7).count() == 0
