"""Every registered query equals its DuckDB twin (rows, columns, values) on the smoke data."""

import duckdb
import pytest

import __spark_entry__ as entry
from seekrank.plans import catalog
from seekrank.sources.tables import TABLES
from tools.compare import canon

NAMES = sorted(catalog.SPARK)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(catalog.SQL) == set(catalog.SPARK) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf, duck, name):
    s = entry.queries()[name](spark, sf).toPandas()
    d = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert canon(s) == canon(d)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "score" in df.columns
