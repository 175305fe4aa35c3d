"""Binary genotype and relationship files read and written by ranges of bytes, a task for each.

Readers take any file system that Arrow opens by its address (local and shared folders, HDFS, object stores). Writers put every
range in a file of its own under a fresh name, renamed once complete, so that a lost task is simply run again; the single file that the
formats ask for is then put together by one task that streams the ranges in order and holds one of them at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that one task reads or writes at a time.
RANGE_BYTES = 8 << 20


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path.removeprefix("file:")


def size_of(path: str) -> int:
    """Bytes of a file; an error where there is none."""
    files, inner = opened(path)
    info = files.get_file_info(inner)
    if info.type != arrow_fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def read_bytes(path: str, start: int, n: int) -> bytes:
    files, inner = opened(path)
    with files.open_input_file(inner) as f:
        return f.read_at(n, start)


def ranges(spark: SparkSession, n: int, each: int) -> DataFrame:
    """(chunk) of n items in chunks of `each`, a partition for every chunk up to some thousand of them."""
    chunks = -(-n // each)
    return spark.range(0, chunks, 1, max(1, min(chunks, 4096))).select(F.col("id").alias("chunk"))


def scratch_name(path: str) -> str:
    """A fresh folder beside `path`, for its ranges."""
    return f"{path}.parts-{uuid.uuid4().hex}"


def put(folder: str, chunk: int, content: bytes) -> int:
    """Writes one range, complete or not at all; the number of bytes."""
    files, inner = opened(folder)
    files.create_dir(inner, recursive=True)
    draft = f"{inner}/draft-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        out.write(content)
    files.move(draft, f"{inner}/range-{chunk:012d}")
    return len(content)


def range_bytes(folder: str, chunk: int) -> bytes | None:
    """What `put` wrote as this range, or None."""
    files, inner = opened(folder)
    try:
        with files.open_input_stream(f"{inner}/range-{chunk:012d}") as f:
            return f.read()
    except FileNotFoundError:
        return None


def joined(spark: SparkSession, folder: str, path: str, header: bytes = b"", prefix: str = "range-") -> None:
    """Streams the files of `folder` that start with prefix, in the order of their names, into `path` in one task, and removes the folder."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            files, inner = opened(folder)
            parts = sorted(i.path for i in files.get_file_info(arrow_fs.FileSelector(inner, allow_not_found=True)) if i.base_name.startswith(prefix))
            draft, total = f"{opened(path)[1]}.draft-{uuid.uuid4().hex}", len(header)
            with files.open_output_stream(draft) as out:
                out.write(header)
                for part in parts:
                    with files.open_input_stream(part) as f:
                        while block := f.read(RANGE_BYTES):
                            total += out.write(block) or len(block)
            files.move(draft, opened(path)[1])
        yield pa.RecordBatch.from_pydict({"n": pa.array([0], pa.int64())})

    spark.range(0, 1, 1, 1).mapInArrow(stream, "n long").collect()  # one number
    files, inner = opened(folder)
    if files.get_file_info(inner).type == arrow_fs.FileType.Directory:
        files.delete_dir(inner)


def write_lines(lines: DataFrame, order: str, path: str) -> None:
    """Column `line` as one text file, sorted by `order`."""
    folder = scratch_name(path)
    lines.orderBy(order).select("line").write.text(folder)
    joined(lines.sparkSession, folder, path, prefix="part-")


def write_triangle(pairs: DataFrame, n: int, path: str, column: str = "value") -> None:
    """`column` of pairs (i, j with j <= i < n) as a lower triangle of 32-bit floats; pairs that are absent or null are 0."""
    total, each = n * (n + 1) // 2, RANGE_BYTES // 4
    folder = scratch_name(path)
    at = (F.col("i") * (F.col("i") + 1) / 2).cast("long") + F.col("j")
    rows = pairs.select(at.alias("at"), F.floor(at / each).cast("long").alias("chunk"), F.coalesce(F.col(column).cast("float"), F.lit(0.0).cast("float")).alias("v"))
    every = ranges(pairs.sparkSession, total, each)

    def fill(key, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        out = np.zeros(min(each, total - chunk * each), "<f4")
        out[right["at"].to_numpy() - chunk * each] = right["v"].to_numpy()
        return pa.table({"n": pa.array([put(folder, chunk, out.tobytes())], pa.int64())})

    every.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(fill, "n long").agg(F.sum("n")).collect()
    joined(pairs.sparkSession, folder, path)
