"""Readers of the domain's file formats, each as a scan that Spark splits and prunes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.sources import byteranges

#: First bytes of a genotype bed file in variant-major order.
BED_MAGIC = bytes([0x6C, 0x1B, 0x01])
#: Genotypes of the four 2-bit codes; None is missing.
BED_CODES = (0, None, 1, 2)


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by suffix, else a table with a header whose separator is the one of tab, comma and semicolon that its first line has most."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    sep = max("\t,;", key=line.count)
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep)


def vcf_alt_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alt, founder, sample, alt_prob) of a text VCF: DS / 2 held in [0, 1], else mean of GT, else 0.5."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("##")))
    header = lines.where(F.startswith("value", F.lit("#CHROM"))).first()
    names = header[0].split("\t")[9:] if header else []
    f = F.split("value", "\t")
    rows = lines.where(~F.startswith("value", F.lit("#"))).select(
        f[0].alias("chrom"), f[1].cast("long").alias("pos"), f[3].alias("ref"), f[4].alias("alt"), F.split(f[8], ":").alias("keys"),
        F.posexplode(F.slice(f, 10, max(1, len(names)))).alias("founder", "entry"),
    )
    values = F.split("entry", ":")
    ds = F.get(values, F.array_position("keys", "DS") - 1).try_cast("double")
    gt = F.get(values, F.array_position("keys", "GT") - 1)
    alleles = F.filter(F.split(gt, "[/|]"), lambda a: a.rlike("^[0-9]+$"))
    mean = F.aggregate(alleles, F.lit(0.0), lambda s, a: s + F.when(a.cast("int") > 0, 1.0).otherwise(0.0)) / F.size(alleles)
    has_ds = F.array_contains("keys", "DS") & ds.isNotNull()
    prob = F.when(has_ds, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ds / 2))).otherwise(F.coalesce(F.when(F.size(alleles) > 0, mean), F.lit(0.5)))
    labels = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return rows.select("chrom", "pos", "ref", "alt", F.col("founder").cast("long").alias("founder"), F.get(labels, F.col("founder")).alias("sample"), prob.alias("alt_prob"))


def fam(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a genotype set, with sample_index from 0 in file order."""
    return _white_space(spark, path, ("fid", "iid", "father", "mother", "sex", "pheno"), "sample_index")


def bim(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a genotype set, with variant_index from 0 in file order."""
    out = _white_space(spark, path, ("chrom", "snp", "cm", "pos", "a1", "a2"), "variant_index")
    return out.withColumn("cm", F.col("cm").cast("double")).withColumn("pos", F.col("pos").cast("long"))


def _white_space(spark: SparkSession, path: str, names: tuple[str, ...], index: str) -> DataFrame:
    """Columns by white space; the index is the rank of a line's place in its file, which one file gives in order."""
    from pyspark.sql import Window

    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path, wholetext=False).where(F.trim("value") != "").withColumn("_at", F.monotonically_increasing_id())
    # a sample or variant list is a small side file of the genotype matrix
    rows = rows.withColumn(index, (F.row_number().over(Window.orderBy("_at")) - 1).cast("long"))
    return rows.select(*[f[i].alias(n) for i, n in enumerate(names)], index)


def bed(spark: SparkSession, path: str, n_samples: int, variants: DataFrame | None = None) -> DataFrame:
    """(variant_index, sample_index, genotype) of a variant-major bed file, null where missing; counts the second allele.

    Tasks read ranges of bytes of their own. With `variants` (variant_index; repeated ones count once) only those variants are read, from
    only those ranges that have some.
    """
    width = (n_samples + 3) // 4
    if byteranges.read_bytes(path, 0, 3) != BED_MAGIC:
        raise ValueError("not a variant-major bed file")
    total = (byteranges.size_of(path) - 3) // width if width else 0
    each = max(1, byteranges.RANGE_BYTES // max(1, width))
    chunks = byteranges.ranges(spark, total, each)
    if variants is None:
        chunks = chunks.withColumn("wanted", F.lit(None).cast("array<bigint>"))
    else:
        own = variants.where(F.col("variant_index").between(0, total - 1)).select(F.col("variant_index").cast("long"))
        chunks = own.groupBy(F.floor(F.col("variant_index") / each).cast("long").alias("chunk")).agg(F.array_sort(F.collect_set("variant_index")).alias("wanted"))
    codes = np.array([-1 if c is None else c for c in BED_CODES], np.int8)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, wanted in zip(batch.column("chunk").to_pylist(), batch.column("wanted")):
                first, last = chunk * each, min(total, (chunk + 1) * each)
                asked = None if not wanted.is_valid else np.asarray(wanted.values, np.int64)
                if asked is not None:
                    first, last = int(asked[0]), int(asked[-1]) + 1
                body = np.frombuffer(byteranges.read_bytes(path, 3 + first * width, (last - first) * width), np.uint8).reshape(-1, width)
                index = np.arange(first, last) if asked is None else asked
                # about a million genotypes in a batch, whatever the number of samples
                step = max(1, (1 << 20) // n_samples)
                for start in range(0, len(index), step):
                    some = index[start : start + step]
                    part = body[some - first]
                    two = np.stack([(part >> s) & 3 for s in (0, 2, 4, 6)], 2).reshape(len(part), -1)[:, :n_samples]
                    g = codes[two].ravel()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "variant_index": np.repeat(some, n_samples),
                            "sample_index": np.tile(np.arange(n_samples), len(part)),
                            "genotype": pa.array(g.astype(np.int32), mask=g < 0),
                        }
                    )

    return chunks.mapInArrow(decode, "variant_index long, sample_index long, genotype int")


def bed_at(spark: SparkSession, prefix: str, positions: DataFrame) -> DataFrame:
    """(chrom, pos, snp, a1, a2, fid, iid, genotype) of a genotype set `prefix`.bed, .bim and .fam at the given sites (chrom, pos), with or without a leading chr.

    Only the ranges of the bed file that hold such variants are read. Lists of samples and variants are joined by exchanges, however
    small their files look: broadcast, they would take memory of the driver that grows with them.
    """
    people, sites = fam(spark, f"{prefix}.fam"), bim(spark, f"{prefix}.bim")
    plain = F.regexp_replace("chrom", "^chr", "")
    wanted = positions.select(plain.alias("_chrom"), F.col("pos").cast("long").alias("pos")).distinct()
    picked = sites.withColumn("_chrom", plain).join(wanted.hint("merge"), ["_chrom", "pos"], "left_semi").drop("_chrom")
    cells = bed(spark, f"{prefix}.bed", people.count(), picked.select("variant_index"))
    out = cells.join(picked.hint("merge"), "variant_index").join(people.select("sample_index", "fid", "iid").hint("merge"), "sample_index")
    return out.select("chrom", "pos", "snp", "a1", "a2", "fid", "iid", "genotype")


def grm_binary(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, value) with j <= i of a lower-triangle float32 file, by ranges of bytes."""
    total, each = byteranges.size_of(path) // 4, byteranges.RANGE_BYTES // 4

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column("chunk").to_pylist():
                v = np.frombuffer(byteranges.read_bytes(path, chunk * each * 4, each * 4), "<f4")
                k = np.arange(len(v)) + chunk * each
                i = ((np.sqrt(8 * k + 1.0) - 1) / 2).astype(np.int64)
                i -= i * (i + 1) // 2 > k  # rounding of the root
                i += (i + 1) * (i + 2) // 2 <= k
                yield pa.RecordBatch.from_pydict({"i": i, "j": k - i * (i + 1) // 2, "value": v.astype(float)})

    return byteranges.ranges(spark, total, each).mapInArrow(decode, "i long, j long, value double")


def grm(spark: SparkSession, prefix: str) -> DataFrame:
    """(fid_i, iid_i, fid_j, iid_j, value, n) of `prefix`.grm.bin, .grm.id and, where there is one, .grm.N.bin (n null without)."""
    ids = _white_space(spark, f"{prefix}.grm.id", ("fid", "iid"), "at")
    out = grm_binary(spark, f"{prefix}.grm.bin")
    try:
        counts = grm_binary(spark, f"{prefix}.grm.N.bin").withColumnRenamed("value", "n")
        out = out.join(counts, ["i", "j"])
    except FileNotFoundError:
        out = out.withColumn("n", F.lit(None).cast("double"))
    for side in ("i", "j"):
        out = out.join(ids.select(F.col("at").alias(side), F.col("fid").alias(f"fid_{side}"), F.col("iid").alias(f"iid_{side}")), side)
    return out.select("fid_i", "iid_i", "fid_j", "iid_j", "value", "n")


def cigar_aligned(reads: DataFrame) -> DataFrame:
    """One row per aligned base of reads: pos and cigar, seq, qual text become ref_pos, base, base_qual; other columns stay.

    M, = and X use both read and reference, I and S the read, D and N the reference, H and P neither. The operations' start
    points are running sums over the cigar's array, and each matching run is expanded by a sequence.
    """
    parts = F.regexp_extract_all("cigar", F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    ops = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"\d+", 0).cast("int").alias("n"), F.right(p, F.lit(1)).alias("op")))
    start = F.struct(F.col("pos").cast("long").alias("ref"), F.lit(0).alias("read"), F.array().cast("array<struct<ref:bigint,read:int,n:int>>").alias("runs"))

    def step(acc, o):
        both = o["op"].isin("M", "=", "X")
        return F.struct(
            (acc["ref"] + F.when(both | o["op"].isin("D", "N"), o["n"]).otherwise(0)).alias("ref"),
            (acc["read"] + F.when(both | o["op"].isin("I", "S"), o["n"]).otherwise(0)).alias("read"),
            F.when(both, F.concat(acc["runs"], F.array(F.struct(acc["ref"].alias("ref"), acc["read"].alias("read"), o["n"].alias("n"))))).otherwise(acc["runs"]).alias("runs"),
        )

    keep = [c for c in reads.columns if c not in ("cigar", "seq", "qual", "pos")]
    rows = reads.withColumn("run", F.explode(F.aggregate(ops, start, step, lambda acc: acc["runs"])))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("run.n") - 1)))
    at = F.col("run.read") + F.col("k") + 1
    return rows.select(*keep, (F.col("run.ref") + F.col("k")).alias("ref_pos"), F.substring("seq", at, F.lit(1)).alias("base"), (F.ascii(F.substring("qual", at, F.lit(1))) - 33).alias("base_qual"))
