"""Filters and draws: reads by flag, quality and depth, variants by frequency, samples and rows by deterministic hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.sources.scratch import forget, never_broadcast, written

#: Bits of a read that is unmapped, secondary, a duplicate or supplementary.
SKIPPED_FLAGS = 0x4 | 0x100 | 0x400 | 0x800
#: The quality that stands for none, what replaces it, and the quality of a base without any.
NO_QUALITY, QUALITY_FOR_NONE, MISSING_QUALITY = 255, 30, 10


def draw(*parts: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values and the seed alone, by md5, so that other engines can draw alike."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2**32)


def read_filter(reads: DataFrame, least_mapq: int = 0, most_insert: int = 0) -> DataFrame:
    """Reads (flag, mapq, tlen) without skipped flags, of enough mapping quality, and no longer insert than allowed (0: any)."""
    out = reads.where((F.col("flag").bitwiseAND(SKIPPED_FLAGS) == 0) & (F.col("mapq") >= least_mapq))
    return out.where(F.abs("tlen") <= most_insert) if most_insert > 0 else out


def base_quality(qual: Column, mapq: Column) -> Column:
    """A base's usable quality: none given counts as 30, a missing one as 10, and none exceeds the mapping quality."""
    known = F.when(qual.isNull(), MISSING_QUALITY).when(qual == NO_QUALITY, QUALITY_FOR_NONE).otherwise(qual)
    return F.least(known, mapq)


def subsampled(reads: DataFrame, probability: Column, *key: str, seed: int = 0) -> DataFrame:
    """Each read, named by `key`, with its probability; a null probability keeps all."""
    return reads.where(probability.isNull() | (draw(*key, seed=seed) <= probability))


def depth_capped(reads: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    """Fragments of a sample in a fixed random order; one goes when all of its sites have `cap` fragments already.

    reads: sample_id, fragment, pos and more columns. The rule looks at what was kept before, but only at shared sites: a fragment stays
    for certain once one of its sites has fewer than `cap` before it that are kept or open, and goes once all have `cap` kept ones.
    Rounds decide what can be told and write the sites that still have open fragments; the first open one of a sample is told in every
    round, and nearly all in the first few. No sample meets in one group.
    """
    if cap <= 0:
        return reads.limit(0)
    reads = reads.where("sample_id is not null and fragment is not null")
    pairs = reads.select("sample_id", "fragment", "pos").distinct().withColumn("turn", F.xxhash64("sample_id", "fragment", F.lit(seed)))
    name = ["sample_id", "fragment"]
    state, gone = written(pairs.withColumn("kept", F.lit(0))), []
    before = Window.partitionBy("sample_id", "pos").orderBy("turn", "fragment").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        sure, open_ = (F.coalesce(F.sum(x).over(before), F.lit(0)) for x in (F.col("kept"), 1 - F.col("kept")))
        told = state.select(*name, "kept", sure.alias("sure"), (sure + open_).alias("most")).where("kept = 0")
        stays, goes = F.min("most") < cap, F.min("sure") >= cap
        told = written(told.groupBy(*name).agg(stays.alias("stays"), goes.alias("goes")))
        gone.append(told.where("goes").select(*name))
        if told.where("not stays and not goes").isEmpty():
            break
        rows = state.join(never_broadcast(told), name, "left").where("goes is null or not goes")
        rows = rows.select(*name, "pos", "turn", F.when(F.coalesce("stays", F.lit(False)), 1).otherwise(F.col("kept")).alias("kept"))
        site = Window.partitionBy("sample_id", "pos")
        after = written(rows.withColumn("least", F.min("kept").over(site)).where("least = 0").drop("least"))
        forget(state)
        state = after
    dropped = gone[0]
    for part in gone[1:]:
        dropped = dropped.unionByName(part)
    return reads.join(never_broadcast(dropped), name, "left_anti")


def truth_source(cells: DataFrame, mode: str) -> DataFrame:
    """cells (read_truth, array_truth; -1 is none) with truth and truth_source by mode: read_evidence, microarray, auto or none.

    auto takes the array where it has a genotype and the reads elsewhere.
    """
    reads, array = F.col("read_truth"), F.coalesce("array_truth", F.lit(-1))
    truth = {"read_evidence": reads, "microarray": array, "auto": F.when(array >= 0, array).otherwise(reads), "none": F.lit(-1)}[mode]
    source = F.when(truth < 0, "none").when(F.lit(mode == "microarray") | (F.lit(mode == "auto") & (array >= 0)), "microarray").otherwise("read_evidence")
    return cells.withColumn("truth", truth.cast("int")).withColumn("truth_source", source)


def passing_variants(long: DataFrame, samples: int, least_call_rate: float = 0.8, least_maf: float = 0.005) -> DataFrame:
    """(variant, call_rate, maf) of variants called often enough and neither rare nor fixed. long: variant, genotype (null or negative: missing)."""
    called = F.col("genotype") >= 0
    af = F.avg(F.when(called, F.col("genotype"))) / 2
    out = long.groupBy("variant").agg((F.count_if(called) / samples).alias("call_rate"), F.least(af, 1 - af).alias("maf"))
    return out.where((F.col("call_rate") >= least_call_rate) & F.col("maf").isNotNull() & (F.col("maf") >= least_maf) & (F.col("maf") <= 0.5))


def chosen(rows: DataFrame, n: int, *key: str, seed: int = 0) -> DataFrame:
    """The n rows with the smallest draws (all, if fewer): a choice without replacement."""
    return rows.withColumn("draw", draw(*key, seed=seed)).orderBy("draw", *key).limit(n).drop("draw")


def balanced(rows: DataFrame, label: str, n: int, *key: str, seed: int = 0) -> DataFrame:
    """n rows with as even classes as there are rows for: each class gives its quota, and the rest is filled from what is left."""
    classes = rows.select(label).distinct().count()  # a label set
    quota = n // max(1, classes)
    rank = F.row_number().over(Window.partitionBy(label).orderBy("draw", *key))
    out = rows.withColumn("draw", draw(*key, seed=seed)).withColumn("rank", rank)
    return out.withColumn("extra", (F.col("rank") > quota).cast("int")).orderBy("extra", "draw", *key).limit(n).drop("draw", "rank", "extra")


def first_discoveries(*found: DataFrame) -> DataFrame:
    """All discovered positions once each by (chrom, pos, ref, alt): the first list that has one decides."""
    out = None
    for i, part in enumerate(found):
        part = part.withColumn("list", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("chrom", "pos", "ref", "alt").orderBy("list"))
    return out.withColumn("nth", first).where("nth = 1").drop("nth", "list")


def smoothed_track(track: DataFrame, value: str, group: str, scale: float = 1e-8) -> DataFrame:
    """(group, pos, smoothed): forward and backward moving averages of `value` along pos, averaged and held in [0, 2].

    track: group, pos, generation, value. A step keeps exp(-generation * distance * scale) of what it carries. A group's track
    is folded in order, as an array of numbers in one row.
    """
    rows = track.groupBy(group, "generation").agg(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("x")))).alias("sites"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sites = batch.column("sites")[i].values
                pos, x = sites.field("pos").to_numpy(), sites.field("x").to_numpy().copy()
                stay = np.exp(-batch.column("generation")[i].as_py() * np.diff(pos) * scale)
                ahead, back = x.copy(), x.copy()
                for t in range(1, len(x)):
                    ahead[t] = stay[t - 1] * ahead[t - 1] + (1 - stay[t - 1]) * x[t]
                for t in range(len(x) - 2, -1, -1):
                    back[t] = stay[t] * back[t + 1] + (1 - stay[t]) * x[t]
                yield pa.RecordBatch.from_pydict(
                    {group: pa.array([batch.column(group)[i].as_py()] * len(x)), "pos": pos, "smoothed": np.clip((ahead + back) / 2, 0, 2)}
                )

    kind = dict(track.dtypes)[group]
    return rows.mapInArrow(run, f"`{group}` {kind}, pos long, smoothed double")
