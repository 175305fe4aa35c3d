"""Every query that SQL can express, against DuckDB; the others at least run."""

import pytest

from lociweave.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(name, same_rows, folder):
    same_rows(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], folder)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_runs(name, spark, folder):
    assert catalogue.QUERIES[name](spark, folder).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["sample_id", "pos", "depth", "ref_count", "alt_count", "other_count", "truth"]
