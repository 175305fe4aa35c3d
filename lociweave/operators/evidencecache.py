"""Evidence kept between runs, under an identity that tells when it may be used again.

A cache is a folder. Every commit writes a part of its own (sites, samples, evidence, all as Parquet sorted by block) and then, last, one
row in `commits`; a part without that row does not exist, so a torn write is ignored. Newer commits stand before older ones
for each block and sample.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

_COMMIT = "part string, number long, settings string"


def settings_hash(settings: dict) -> str:
    """SHA-256 of the settings as JSON with sorted keys, whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def site_hashes(sites: DataFrame) -> DataFrame:
    """(chrom, block, n_sites, sites_hash): SHA-256 over a block's sites (chrom, block, pos, ref, alt) in their order; the block's size bounds the group."""
    text = F.concat_ws("\0", F.col("pos").cast("string"), "ref", "alt")
    return sites.groupBy("chrom", "block").agg(
        F.count(F.lit(1)).alias("n_sites"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref", "alt", text.alias("t")))), lambda x: x["t"]), "\1"), 256).alias("sites_hash")
    )


def commits(spark: SparkSession, folder: str, settings: dict) -> DataFrame:
    """(part, number) of complete commits with these settings; none where there is no cache yet."""
    try:
        rows = spark.read.schema(_COMMIT).parquet(f"{folder}/commits")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        rows = spark.createDataFrame([], _COMMIT)
    return rows.where(F.col("settings") == settings_hash(settings)).select("part", "number")


def _by_block(rows: DataFrame) -> DataFrameWriter:
    return rows.withColumn("block", F.col("block").cast("long")).sortWithinPartitions("chrom", "block").write.option("compression", "zstd")


def store(evidence: DataFrame, sites: DataFrame, samples: DataFrame, folder: str, settings: dict) -> str:
    """Adds a commit: evidence (chrom, block, sample_id, pos, any values) of all of `samples` (sample_id) at `sites` (chrom, block, pos, ref, alt); its name.

    Samples without evidence are remembered too: they were looked at. One writer at a time gives commits increasing numbers. A task writes one
    file, in which chrom and block are columns, so files are as many as tasks, however many blocks there are.
    """
    spark = evidence.sparkSession
    part = f"part-{uuid.uuid4().hex}"
    known = commits(spark, folder, settings).agg(F.max("number")).first()[0]
    at = f"{folder}/{part}"
    _by_block(sites.select("chrom", "block", "pos", "ref", "alt")).parquet(f"{at}/sites")
    samples.select("sample_id").distinct().write.parquet(f"{at}/samples")
    _by_block(evidence).parquet(f"{at}/evidence")
    row = spark.createDataFrame([(part, (known or 0) + 1, settings_hash(settings))], _COMMIT)
    row.coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    return part


def lookup(spark: SparkSession, folder: str, sites: DataFrame, samples: DataFrame, settings: dict, schema: str) -> tuple[DataFrame, DataFrame]:
    """(evidence, missing): what the cache has of the wanted sites (chrom, block, pos, ref, alt) and samples, and the (chrom, block, sample_id) that it lacks.

    A commit answers for a block if it has all the wanted sites of it with the same alleles; more sites do no harm, and only the wanted ones
    are returned. Of several commits the newest answers. `schema` gives the columns of evidence but for chrom and block. Commits are a handful; their
    tables are read by name, so parts without a commit are never listed.
    """
    known = commits(spark, folder, settings).orderBy("number").collect()
    wanted = sites.select("chrom", F.col("block").cast("long").alias("block"), "pos", "ref", "alt").distinct()
    people = samples.select("sample_id").distinct()
    blocks = wanted.select("chrom", "block").distinct()
    # every block needs every sample: as many rows as answers are asked for
    need = blocks.withColumn("_", F.lit(1)).join(people.withColumn("_", F.lit(1)), "_").drop("_")
    if not known:
        return spark.createDataFrame([], f"chrom string, block long, {schema}"), need

    def united(name: str, columns: str, blocks_too: bool) -> DataFrame:
        out = None
        for row in known:
            df = spark.read.schema((columns + (", chrom string, block long" if blocks_too else ""))).parquet(f"{folder}/{row['part']}/{name}").withColumn("number", F.lit(row["number"]))
            out = df if out is None else out.unionByName(df)
        return out

    held = united("sites", "pos long, ref string, alt string", True)
    size = wanted.groupBy("chrom", "block").agg(F.count(F.lit(1)).alias("n"))
    has = held.join(wanted, ["chrom", "block", "pos", "ref", "alt"]).distinct().groupBy("number", "chrom", "block").agg(F.count(F.lit(1)).alias("m"))
    answers = has.join(size, ["chrom", "block"]).where("m = n").select("number", "chrom", "block")
    cells = answers.join(united("samples", "sample_id long", False).join(people, "sample_id"), "number")
    newest = cells.groupBy("chrom", "block", "sample_id").agg(F.max("number").alias("number"))
    found = united("evidence", schema, True).join(newest, ["chrom", "block", "sample_id", "number"])
    found = found.join(wanted.select("chrom", "block", "pos").distinct(), ["chrom", "block", "pos"], "left_semi").drop("number")
    names = [c.split()[0] for c in schema.split(", ")]
    return found.select("chrom", "block", *names), need.join(newest, ["chrom", "block", "sample_id"], "left_anti")
