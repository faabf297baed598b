"""Every registered query against its SQL twin in DuckDB: names, types, rows and values."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
from shelfwise.plans.registry import QUERIES

from .conftest import TESTDATA

duckdb = pytest.importorskip("duckdb")
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
FOLDER = os.path.join(TESTDATA, "sf0.01")
TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    df = driver.queries()[name](spark, FOLDER)
    rows = sorted(str(tuple(row)) for row in df.collect())
    twin = duck.execute(driver.oracle_sql()[name])
    assert [(c, TYPES[t]) for c, t in df.dtypes] == [(d[0], str(d[1])) for d in twin.description]
    assert rows == sorted(str(row) for row in twin.fetchall())
    assert rows


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() > 0
