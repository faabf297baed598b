"""Every query on tables where one order, part, supplier and customer each hold a third of all rows.

Broadcasts are off, so all joins shuffle on the hot keys; results must equal the SQL twins.
"""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from shelfwise.operators import sales
from shelfwise.plans import registry, session

from .conftest import TESTDATA
from .test_oracle import TABLES

duckdb = pytest.importorskip("duckdb")
HOT_ORDER = 1  # a delivered one


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    folder = tmp_path_factory.mktemp("hot")
    con = duckdb.connect()
    source = f"{TESTDATA}/sf0.001"
    changes = {
        "lineitem": f"""* REPLACE (
            CASE WHEN rid % 3 = 0 THEN {HOT_ORDER} ELSE l_orderkey END AS l_orderkey,
            CASE WHEN rid % 3 = 1 THEN 7 ELSE l_partkey END AS l_partkey,
            CASE WHEN rid % 3 = 2 THEN 3 ELSE l_suppkey END AS l_suppkey)""",
        "orders": "* REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey)",
    }
    for table in TABLES:
        what = changes.get(table, "*")
        con.execute(
            f"""COPY (SELECT * EXCLUDE (rid) FROM (SELECT {what} FROM
            (SELECT *, row_number() OVER () AS rid FROM '{source}/{table}.parquet')))
            TO '{folder}/{table}.parquet' (FORMAT parquet)"""
        )
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return str(folder), con


@pytest.fixture()
def no_broadcast(conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "4KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4KB")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_hot_keys_match_sql(spark, hot, no_broadcast, name):
    folder, con = hot
    got = sorted(str(tuple(row)) for row in driver.queries()[name](spark, folder).collect())
    assert got == sorted(str(row) for row in con.execute(driver.oracle_sql()[name]).fetchall())


def test_join_on_a_hot_order_is_split(spark, conf, no_broadcast, tmp_path):
    """The line-order join splits the hot order although the counts after it want whole orders."""
    for key, value in session.ADAPTIVE_SETTINGS.items():
        conf(key, value)
    con = duckdb.connect()
    source = f"{TESTDATA}/sf0.01"
    con.execute(
        f"""COPY (SELECT * REPLACE (CASE WHEN hash(l_partkey, l_quantity) % 3 = 0 THEN {HOT_ORDER} ELSE l_orderkey END
        AS l_orderkey) FROM '{source}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 8192)"""
    )
    for table in ("orders", "part"):
        con.execute(f"COPY (SELECT * FROM '{source}/{table}.parquet') TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    conf("spark.sql.files.maxPartitionBytes", "128KB")
    df = sales.channel_performance(registry.CanonicalModel(spark, str(tmp_path)).orders)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true) [l_orderkey" in plan
