"""One small Spark session for all tests, and DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    """A value that compares equal whichever engine made it."""
    if isinstance(value, float):
        return None if value != value else round(value, 6) + 0.0
    if isinstance(value, bool):
        return bool(value)
    return float(value) if type(value).__name__ == "Decimal" else value


def rows_of(columns, rows):
    """Sorted rows with columns in the order of their names."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture
def same_rows(spark, duck):
    """Compares a Spark query with SQL on the same tables."""

    def check(query, sql, where):
        got = query(spark, where)
        con = duck.execute(sql)
        names = [d[0] for d in con.description]
        assert sorted(names) == sorted(got.columns)
        assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, con.fetchall())

    return check
