"""The queries that SQL can express, against DuckDB: on the test tables and on odd ones."""

from __future__ import annotations

import pytest

from shelfwise.llm import queries

from ..conftest import TESTDATA
from .conftest import ODD, prose, same_rows
from .test_spans import PERSONAL, SECRETS

duckdb = pytest.importorskip("duckdb")


def rows_of_twin(name, folder, pattern):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet{pattern}'")
    twin = con.execute(queries.ORACLE_SQL[name])
    return [d[0] for d in twin.description], twin.fetchall()


@pytest.fixture(scope="module")
def odd_folder(spark, docs_of, folder_of):
    mail = "owner@corp.example.org"
    revealing = [(8000 + i, f"{prose(i, 12)} project manhattan lead {mail} asked {prose(i + 50, 12)}") for i in range(4)]
    others = [(8100 + i, prose(10 + i, 30) + " lead asked them") for i in range(30)]
    items = [(i, prose(600 + i, 20)) for i in range(5)] + [(20, "two Words"), (21, "Single"), (22, ""), (23, None)]
    marked = [(8200 + i, f"{prose(800 + i, 30)} {prose(600 + i, 20).upper()}") for i in range(5)] + [(8300, "two-words, single TWO words")]
    return folder_of(
        documents=docs_of(SECRETS + PERSONAL + ODD + revealing + revealing[:1] + others + marked),
        benchmark=spark.createDataFrame(items, "item_id long, text string"),
    )


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_on_odd_tables(spark, odd_folder, name):
    names, expected = rows_of_twin(name, odd_folder, "/*.parquet")
    got = queries.QUERIES[name](spark, odd_folder).select(*names).collect()
    same_rows(got, expected)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_on_the_test_table(spark, name):
    folder = f"{TESTDATA}/sf0.001"
    names, expected = rows_of_twin(name, folder, "")
    df = queries.QUERIES[name](spark, folder)
    assert set(df.columns) == set(names)
    same_rows(df.select(*names).collect(), expected)
