"""Readers, writers, streams and models on hand-made files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.operators import mixedmodels, models, sinks
from lociweave.sources import formats
from lociweave.streaming import counts


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("CHR\tPOS\n1\t5\n2\t7\n")
    assert [tuple(r) for r in formats.delimited(spark, str(tmp_path / "a.tsv")).orderBy("POS").collect()] == [(1, 5), (2, 7)]


def test_vcf(spark, tmp_path):
    lines = ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB", "1\t10\t.\tA\tG\t.\t.\t.\tGT:DS\t0/1:1.5\t./.:.", "1\t11\t.\tA\tG\t.\t.\t.\tGT\t1|1\t0|1"]
    (tmp_path / "f.vcf").write_text("\n".join(lines) + "\n")
    got = {(r.pos, r["sample"]): r.alt_prob for r in formats.vcf_alt_probabilities(spark, str(tmp_path / "f.vcf")).collect()}
    assert got == {(10, "A"): 0.75, (10, "B"): 0.5, (11, "A"): 1.0, (11, "B"): 0.5}


def test_bed_byte_and_back(spark, tmp_path):
    (tmp_path / "x.bed").write_bytes(formats.BED_MAGIC + bytes([0xE4]))
    rows = formats.bed(spark, str(tmp_path / "x.bed"), 4)
    assert [r.genotype for r in rows.orderBy("sample_index").collect()] == [0, None, 1, 2]
    packed = sinks.bed_rows(rows.select("variant_index", "sample_index", F.col("genotype").alias("dosage")), 4)
    assert bytes(packed.first().packed) == bytes([0xE4])


def test_bad_bed_is_an_error(spark, tmp_path):
    (tmp_path / "x.bed").write_bytes(b"\0\0\0\0")
    with pytest.raises(Exception, match="not a variant-major bed file"):
        formats.bed(spark, str(tmp_path / "x.bed"), 4).collect()


def test_fam_and_bim(spark, tmp_path):
    (tmp_path / "x.fam").write_text("f a 0 0 1 -9\nf  b a 0 2 -9\n")
    assert [(r.iid, r.sample_index) for r in formats.fam(spark, str(tmp_path / "x.fam")).orderBy("sample_index").collect()] == [("a", 0), ("b", 1)]
    (tmp_path / "x.bim").write_text("1 s 0.5 10 A G\n")
    assert tuple(formats.bim(spark, str(tmp_path / "x.bim")).first())[:4] == ("1", "s", 0.5, 10)


def test_grm_binary(spark, tmp_path):
    np.arange(6, dtype="<f4").tofile(tmp_path / "x.grm.bin")
    got = {(r.i, r.j): r.value for r in formats.grm_binary(spark, str(tmp_path / "x.grm.bin")).collect()}
    assert got == {(0, 0): 0, (1, 0): 1, (1, 1): 2, (2, 0): 3, (2, 1): 4, (2, 2): 5}


def test_cigar(spark):
    reads = spark.createDataFrame([("q", 100, "2S2M1I1M2D1M", "TTACGGT", "IIIIIII")], "name string, pos long, cigar string, seq string, qual string")
    got = [(r.ref_pos, r.base, r.base_qual) for r in formats.cigar_aligned(reads).orderBy("ref_pos").collect()]
    assert got == [(100, "A", 40), (101, "C", 40), (102, "G", 40), (105, "T", 40)]


def test_blocks_and_combine(spark, tmp_path):
    df = spark.createDataFrame([("1", 0, 5, 0.5), ("1", 1, 9, 1.5)], "chromosome string, block_id int, position long, dosage double")
    sinks.write_blocks(df, f"{tmp_path}/dosage", "chromosome", "block_id")
    sinks.write_blocks(df.where("block_id = 1").withColumn("dosage", F.lit(2.0)), f"{tmp_path}/dosage", "chromosome", "block_id")
    out = sinks.combined(spark, str(tmp_path), {"dosage": ["position", "dosage"]})
    assert sorted(tuple(r) for r in out["dosage"].collect()) == [(5, 0.5), (9, 2.0)]
    with pytest.raises(ValueError, match="unknown suffix"):
        sinks.write_table(df, f"{tmp_path}/x.doc")


def test_vcf_line(spark):
    cells = spark.createDataFrame([("1", 5, "A", "G", 2, 2.0, [0.0, 0.0, 1.0], 2), ("1", 5, "A", "G", 1, 0.0, None, -1)], "chrom string, pos long, ref string, alt string, sample_id long, dosage double, gp array<double>, call int")
    line = sinks.vcf_lines(cells).first().line.split("\t")
    assert line[:5] == ["1", "5", ".", "A", "G"] and line[8] == "GT:DS:GP" and line[9].startswith("./.:0") and line[10] == "1/1:2:0,0,1"


def test_stream_equals_batch(spark, tmp_path):
    reads = spark.createDataFrame([(i % 3, i % 5, i % 2) for i in range(60)], "sample_id long, pos long, code int")
    reads.repartition(4).write.parquet(f"{tmp_path}/reads")
    stream = counts.opened(spark, f"{tmp_path}/reads/*.parquet", reads.schema, files=1)
    got = counts.drained(counts.running_evidence(stream))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, counts.running_evidence(reads).collect()))


def test_heritability_and_blup(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(120, 300))
    k = z @ z.T / 300
    y = np.linalg.cholesky(0.6 * k + 0.4 * np.eye(120)) @ rng.normal(size=120)
    long = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(120) for j in range(300)], "id long, variant long, dosage double")
    traits = spark.createDataFrame([(i, "t", float(y[i])) for i in range(120)], "id long, trait string, value double")
    u, s = mixedmodels.eigenvectors(mixedmodels.standardised(long), 120)
    parts = mixedmodels.rotated(u, s, traits)
    h2 = mixedmodels.heritability(parts)
    blup = {r.id: r.value for r in mixedmodels.corrected(u, parts, h2, "blup", traits).collect()}
    assert 0.2 < h2.first().h2 <= 1 and np.corrcoef([blup[i] for i in range(120)], y)[0, 1] > 0.5


def test_isotonic_does_not_decrease(spark):
    rows = spark.createDataFrame([(i / 50, int((i * 7) % 50 < i)) for i in range(50)], "score double, hit int")
    out = [r.calibrated for r in models.isotonic(rows, "score", "hit").orderBy("score").collect()]
    assert out == sorted(out)
