"""Named Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`: one Parquet file or a folder of them, by any path that Spark reads."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def views(spark: SparkSession, folder: str, *names: str) -> None:
    """Registers tables of `folder` as temporary views of their own names."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
