"""Results that are written once and read again, so that lineage ends there and lost executors do not matter.

All files go below the folder that `spark.checkpoint.dir` names, which driver and executors share.
Only where that setting is absent (tests on one machine) a temporary folder takes its place.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="lociweave-")
    return _local[app]


def written(df: DataFrame) -> DataFrame:
    """`df` as Parquet in the shared folder, read again with the same schema.

    Spark removes a finished query's shuffle files when the driver collects its garbage, which by default may take half an
    hour; asking for it here keeps the shuffles of a chain of such steps from piling up on the executors' disks.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def never_broadcast(df: DataFrame) -> DataFrame:
    """`df` as a side of a join by exchanges at all sizes: Spark broadcasts by the size of compressed files, or of what a Python step reads, and rows may be a hundred times that."""
    return df.hint("merge")


def forget(df: DataFrame | None) -> None:
    """Deletes what `written` made, once nothing reads it any more."""
    path = getattr(df, "written_path", None)
    if path:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
