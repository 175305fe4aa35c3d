"""Writers of results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.sources import byteranges
from lociweave.sources.formats import BED_MAGIC

BLOCKS = ("dosage", "support_mask", "recombination", "transitions", "haplotype_probabilities", "genotype_posteriors", "genotype_calls", "founder_updates")


def write_blocks(df: DataFrame, path: str, *by: str, mode: str = "overwrite") -> None:
    """Partitioned Parquet, zstd; with `overwrite` only the partitions that df has are replaced."""
    df.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, CSV or TSV by suffix (.txt is TSV)."""
    suffix = path.rpartition(".")[2]
    if suffix == "parquet":
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    elif suffix in ("csv", "tsv", "txt"):
        df.write.mode("overwrite").csv(path, header=True, sep="," if suffix == "csv" else "\t")
    else:
        raise ValueError(f"unknown suffix {suffix!r}: parquet, csv, tsv or txt")


def combined(spark: SparkSession, folder: str, columns: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The block outputs that exist below `folder`, each with the asked columns only."""
    out = {}
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in BLOCKS:
        path = where(f"{folder}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            df = spark.read.parquet(f"{folder}/{name}")
            out[name] = df.select(*columns[name]) if columns and name in columns else df
    return out


def missing_samples(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Samples that a cache lacks."""
    return wanted.join(cached.select("sample_id").distinct(), "sample_id", "left_anti")


def vcf_lines(cells: DataFrame) -> DataFrame:
    """(chrom, pos, line): one VCF line per site with GT:DS:GP in the order of samples. cells: chrom, pos, ref, alt, sample_id, dosage, gp, call.

    Without gp its softmax of the dosage stands in, without a call the most probable genotype. A site's samples are one line
    of the file, so they meet in one row.
    """
    from lociweave.operators import posterior as gp_

    gp = F.coalesce(F.col("gp"), gp_.from_dosage(F.col("dosage")))
    call = F.coalesce(F.col("call"), gp_.argmax(gp))
    gt = F.when(call < 0, "./.").when(call == 0, "0/0").when(call == 1, "0/1").otherwise("1/1")

    def short(x):
        return F.regexp_replace(F.format_number(x, 4), r"\.?0+$", "")

    entry = F.concat_ws(":", gt, short(F.coalesce("dosage", gp_.dosage(gp))), F.array_join(F.transform(gp, short), ","))
    site = cells.withColumn("entry", F.struct("sample_id", entry.alias("text"))).groupBy("chrom", "pos", "ref", "alt").agg(F.array_sort(F.collect_list("entry")).alias("e"))
    head = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:DS:GP"))
    return site.select("chrom", "pos", F.concat_ws("\t", head, F.array_join(F.transform("e", lambda x: x["text"]), "\t")).alias("line"))


def bed_rows(dosages: DataFrame, n_samples: int) -> DataFrame:
    """(variant_index, packed): two-bit genotypes of each variant, low bits first. dosages: variant_index, sample_index, dosage (null: missing)."""
    g = F.rint(F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.col("dosage")))).cast("int")
    code = F.when(F.col("dosage").isNull(), 1).when(g == 0, 0).when(g == 1, 2).otherwise(3)
    rows = dosages.select("variant_index", F.struct(F.col("sample_index").cast("int").alias("at"), code.alias("code")).alias("c"))
    rows = rows.groupBy("variant_index").agg(F.collect_list("c").alias("cs"))
    width = (n_samples + 3) // 4

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cs in batch.column("cs"):
                two = np.ones(width * 4, np.uint8)
                two[n_samples:] = 0
                two[cs.values.field("at").to_numpy()] = cs.values.field("code").to_numpy()
                q = two.reshape(-1, 4)
                out.append((q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("variant_index"), pa.array(out, pa.binary())], names=["variant_index", "packed"])

    return rows.mapInArrow(pack, "variant_index long, packed binary")


def write_genotype_set(dosages: DataFrame, samples: DataFrame, variants: DataFrame, prefix: str) -> None:
    """`prefix`.bed, .fam and .bim. dosages: variant_index, sample_index, dosage (null or absent: missing); samples: sample_index from 0, fid, iid, father,
    mother, sex, pheno; variants: variant_index from 0, chrom, snp, cm, pos, a1, a2.

    Ranges of variants are packed and written by tasks of their own; a variant without dosages is missing throughout.
    """
    spark = dosages.sparkSession
    n_samples, n_variants = samples.count(), variants.count()
    width = (n_samples + 3) // 4
    each = max(1, byteranges.RANGE_BYTES // max(1, width))
    folder = byteranges.scratch_name(f"{prefix}.bed")
    rows = bed_rows(dosages, n_samples).withColumn("chunk", F.floor(F.col("variant_index") / each).cast("long"))
    empty = np.ones(width * 4, np.uint8)
    empty[n_samples:] = 0
    missing = (empty.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)

    def fill(key, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        out = np.tile(missing, (min(each, n_variants - chunk * each), 1))
        for index, packed in zip(right["variant_index"].to_numpy(), right["packed"]):
            out[index - chunk * each] = np.frombuffer(packed.as_py(), np.uint8)
        return pa.table({"n": pa.array([byteranges.put(folder, chunk, out.tobytes())], pa.int64())})

    byteranges.ranges(spark, n_variants, each).groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(fill, "n long").agg(F.sum("n")).collect()
    byteranges.joined(spark, folder, f"{prefix}.bed", BED_MAGIC)
    for df, order, names, suffix in (
        (samples, "sample_index", ("fid", "iid", "father", "mother", "sex", "pheno"), "fam"), (variants, "variant_index", ("chrom", "snp", "cm", "pos", "a1", "a2"), "bim"),
    ):
        line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in names])
        byteranges.write_lines(df.select(order, line.alias("line")), order, f"{prefix}.{suffix}")


def write_grm(pairs: DataFrame, ids: DataFrame, prefix: str) -> None:
    """`prefix`.grm.bin and .grm.id, and .grm.N.bin where pairs has n. pairs: i, j (in either order), value; ids: at from 0, fid, iid."""
    n = ids.count()
    lower = pairs.withColumn("_i", F.greatest("i", "j")).withColumn("_j", F.least("i", "j")).drop("i", "j").withColumnsRenamed({"_i": "i", "_j": "j"})
    byteranges.write_triangle(lower, n, f"{prefix}.grm.bin")
    if "n" in pairs.columns:
        byteranges.write_triangle(lower, n, f"{prefix}.grm.N.bin", "n")
    byteranges.write_lines(ids.select("at", F.concat_ws("\t", "fid", "iid").alias("line")), "at", f"{prefix}.grm.id")


def renamed(names: DataFrame, column: str, pattern: str, to: str) -> DataFrame:
    """Names with a new_name by a regular expression, and whether it differs."""
    new = F.regexp_replace(column, pattern, to)
    return names.withColumn("new_name", new).withColumn("changed", new != F.col(column))
