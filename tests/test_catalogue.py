"""Every query that has SQL against DuckDB, over whole tables."""

import duckdb
import pytest

from vecloom.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DIR}/embeddings.parquet'")
    want = con.sql(catalogue.SQL[name]).df()
    got = catalogue.Q[name](spark, DIR).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    assert all((a[c].values == b[c].values).all() for c in columns)


def test_every_query_has_sql():
    assert set(catalogue.SQL) == set(catalogue.Q)


def test_entry():
    import __spark_entry__ as entry

    assert set(catalogue.SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
