"""Every registered query against its SQL on the smallest test data."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check_oracle import rows_of
from marketops.sources.fixtures import TABLES

ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query_equals_sql(spark, sf, con, name):
    df = entry_module.queries()[name](spark, sf)
    got = df.collect()
    if name not in ORACLES:
        return
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, cur.fetchall())


def test_entry_has_rows_and_stable_schema(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert df.schema == entry_module.entry(spark).schema
