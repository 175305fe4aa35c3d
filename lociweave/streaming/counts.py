"""Incremental evidence and event counts by Structured Streaming. An extension: the batch operators need none of it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lociweave.sources.scratch import shared_folder


def opened(spark: SparkSession, pattern: str, schema: StructType, files: int = 8) -> DataFrame:
    """A stream of the Parquet files that match `pattern`, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern)


def windowed(events: DataFrame, time: str, length: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of `value` per window and keys; rows later than `late` are dropped once the watermark has passed."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, length).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), *keys, "n", "total")
    )


def running_evidence(reads: DataFrame) -> DataFrame:
    """Reference, alternative and other counts per (sample, position) that grow with the stream."""
    return reads.groupBy("sample_id", "pos").agg(*[F.count_if(F.col("code") == c).alias(n) for c, n in enumerate(("ref_count", "alt_count", "other_count"))])


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream over all that is there now; state and result live in the shared folder."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{place}/out")

    query = (
        stream.writeStream.outputMode(mode)
        .trigger(availableNow=True)
        .option("checkpointLocation", f"{place}/state")
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
