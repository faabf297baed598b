"""CSV loads with bad rows, repeated registration, and duplicates of wide keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import quality
from shelfwise.sources import load_tables, load_with_rejects, read_with_rejects, register_marts, write_marts
from shelfwise.sources.rejects import COLUMN_COUNT

from .conftest import records
from .test_scale import plan

HEADER = "product_id,mrp,colour,launch_date,is_licensed,initial_stock_units,product_name"
GOOD = ["P1,10.5,red,2024-02-29,True,12.0,Shirt", 'P2,,blue,,false,,"A, B"', "P3,1e2,,2020-01-01,,7,", ",,,,,,"]
BAD = {
    "P4,ten,red,2024-01-01,True,1,x": "mrp is no double",
    "P5,1,red,2023-02-29,True,1,x": "launch_date is no date",
    "P6,1,red,2024-01-01,maybe,1.5,x": "is_licensed is no boolean; initial_stock_units is no bigint",
    "P7,1,red": COLUMN_COUNT,
    "P8,1,red,2024-01-01,True,1,x,more": COLUMN_COUNT,
    "P9,1,red,2024-01-01,True,99999999999999999999,x": "initial_stock_units is no bigint",
}


@pytest.fixture()
def csv(tmp_path):
    """A folder with two files of one table, each with the header, bad rows and blank lines in both."""
    table = tmp_path / "products.csv"
    table.mkdir()
    bad = list(BAD)
    (table / "a.csv").write_text("\n".join([HEADER, GOOD[0], *bad[:3], "", GOOD[1]]) + "\n")
    (table / "b.csv").write_text("\n".join([HEADER, *bad[3:], "   ", *GOOD[2:]]))
    return str(tmp_path)


def test_good_rows_load_and_bad_ones_keep_their_reason(spark, csv):
    good, bad = read_with_rejects(spark, csv, "products")
    rows = {r["product_id"]: r for r in records(good)}
    assert set(rows) == {"P1", "P2", "P3", None} and "colour" not in good.columns
    assert (rows["P1"]["mrp"], str(rows["P1"]["launch_date"]), rows["P1"]["initial_stock_units"], rows["P1"]["is_licensed"]) == (10.5, "2024-02-29", 12, True)
    assert rows["P2"]["product_name"] == "A, B" and rows["P2"]["mrp"] is None and rows["P3"]["mrp"] == 100.0
    assert {r["line"]: r["reason"] for r in records(bad)} == BAD
    assert {r["file"].rsplit("/", 1)[1] for r in records(bad)} == {"a.csv", "b.csv"} and {r["table_name"] for r in records(bad)} == {"products"}
    assert dict(good.dtypes)["initial_stock_units"] == "bigint" and "Python" not in plan(good)


def test_without_bad_rows_it_loads_what_the_strict_load_does(spark, csv, tmp_path):
    for name in ("a", "b"):
        (tmp_path / "products.csv" / f"{name}.csv").write_text("\n".join([HEADER, *GOOD[:3]]) + "\n")
    tables, bad = load_with_rejects(spark, csv, ["products"])
    assert sorted(map(str, records(tables.products))) == sorted(map(str, records(load_tables(spark, csv, names=["products"]).products)))
    assert bad.count() == 0


def test_files_without_header_lines(spark, tmp_path):
    (tmp_path / "products.csv").write_text("\n".join([*GOOD, *BAD]))
    good, bad = read_with_rejects(spark, str(tmp_path), "products", HEADER.split(","))
    assert good.count() == len(GOOD) and bad.count() == len(BAD)


def test_marts_can_be_registered_again(spark, make, tmp_path):
    for n in (1, 2):
        tables = load_of(make, n)
        write_marts(tables, str(tmp_path / str(n)))
        assert register_marts(spark, str(tmp_path / str(n)), "again", ["products"]) == ["again.products"]
        assert spark.table("again.products").count() == n
    spark.sql("DROP DATABASE again CASCADE")


def load_of(make, n):
    from shelfwise.sources import Tables

    return Tables(products=make("products", [{"product_id": f"P{i}"} for i in range(n)]))


@pytest.mark.parametrize("digest", [F.xxhash64, lambda *keys: F.lit(1), lambda a, b: F.coalesce(F.length(a), F.lit(0))])
def test_duplicates_of_wide_keys(spark, digest):
    """Planted duplicates, NULL keys, a key on a third of the rows, and hashes that all or many keys share."""
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("a"), F.when(F.col("id") % 3 != 0, F.col("id") % 2).alias("b")
    ).unionByName(spark.createDataFrame([("k1", 1), (None, 5), (None, 5), ("x", None), (None, None)], "a string, b bigint"))
    got = quality.wide_key_check(rows, ["a", "b"], digest)
    assert sorted(map(str, records(got))) == sorted(map(str, records(quality.key_uniqueness_check(rows, ["a", "b"]))))
    assert {(r["a"], r["b"], r["row_count"]) for r in records(got)} == {("hot", None, 300), ("k1", 1, 2), (None, 5, 2)}
