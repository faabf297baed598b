"""Marts loaded batch by batch, additive states, and reports kept up to date."""

from __future__ import annotations

import datetime
import pathlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfwise.functions import states
from shelfwise.operators import builders, customers, increments, sales
from shelfwise.operators.increments import SALES_GRAIN, SET_GRAIN, Increments
from shelfwise.plans import registry
from shelfwise.sources import batches

from .conftest import TESTDATA, records
from .test_scale import plan

SMALL = f"{TESTDATA}/sf0.001"


def line(order, customer, day, category="A", channel="Web", quantity=1, discount=0.0, status="Delivered"):
    """A line of an order; its calendar columns follow from the day."""
    date = datetime.date.fromisoformat(day) if day else None
    calendar = {"year": date.year, "month": date.month, "quarter": f"Q{(date.month + 2) // 3}"} if date else {"year": None, "month": None, "quarter": None}
    return {
        "order_id": order, "customer_id": customer, "order_date": date, **calendar, "category": category, "channel": channel,
        "quantity": quantity, "discount_pct": discount, "order_status": status, "is_returned": status == "Returned",
    }


def random_lines(seed, orders=120):
    draw, lines = random.Random(seed), []
    for i in range(orders):
        day = draw.choice([None, *(f"{y}-{m:02d}-{d:02d}" for y in (2022, 2023) for m in (1, 11) for d in (1, 9))])
        customer, channel = draw.choice([None, "hot", "hot", *"abcdefgh"]), draw.choice(["Web", "Store", None])
        status = draw.choice(["Delivered", "Delivered", "Returned", "Cancelled"])
        for _ in range(draw.randint(1, 4)):
            lines.append(line(f"o{i:03d}", customer, day, draw.choice(["A", "B", None]), channel, draw.randint(1, 5), draw.choice([0.0, 10.0, 25.0]), status))
    return lines


def same(got, expected):
    assert got.columns == expected.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def files(path):
    return {str(p.relative_to(path)) for p in pathlib.Path(path).rglob("*.parquet") if p.is_file() and "/rows/" in str(p)}


def test_a_batch_is_loaded_once(make, spark, tmp_path):
    first, second = make("orders", random_lines(1)), make("orders", random_lines(2))
    assert batches.refresh_mart(first, str(tmp_path), "orders", "one")
    assert [r["row_count"] for r in batches.current_loads(spark, str(tmp_path), "orders").collect()] == [first.count()]
    assert batches.refresh_mart(second, str(tmp_path), "orders", "two")
    whole, there = first.unionByName(second), files(tmp_path)
    same(batches.read_mart(spark, str(tmp_path), "orders"), whole)
    assert not batches.refresh_mart(second, str(tmp_path), "orders", "two")
    assert files(tmp_path) == there and batches.mart_log(spark, str(tmp_path), "orders").count() == 2
    assert batches.read_mart(spark, str(tmp_path), "orders").schema.simpleString() == first.schema.simpleString()


def test_late_lines_add_to_their_years_alone(make, spark, tmp_path):
    batches.refresh_mart(make("orders", [line("o1", "a", "2022-01-01"), line("o2", "a", "2023-01-01")]), str(tmp_path), "orders", "one")
    before = files(tmp_path)
    batches.refresh_mart(make("orders", [line("o3", "b", "2022-02-01")]), str(tmp_path), "orders", "late")
    new = files(tmp_path) - before
    assert before < files(tmp_path) and len(new) == 1 and all("/year=2022/" in f for f in new)
    mart = batches.read_mart(spark, str(tmp_path), "orders")
    assert "PartitionFilters: [isnotnull(year" in plan(mart.filter("year = 2022"))
    assert mart.filter("year = 2022").count() == 2


def test_a_failed_write_leaves_what_was_there(make, spark, tmp_path):
    good = make("orders", random_lines(3))
    batches.refresh_mart(good, str(tmp_path), "orders", "one")
    bad = good.withColumn("category", F.when(F.col("order_id") > "o100", F.raise_error(F.lit("broken"))).otherwise("A").cast("string"))
    for batch, replace in (("two", False), ("one", True)):
        with pytest.raises(PySparkException):
            batches.refresh_mart(bad, str(tmp_path), "orders", batch, replace=replace)
    (tmp_path / "orders" / "rows" / "load=torn").mkdir()
    (tmp_path / "orders" / "rows" / "load=torn" / "part-0.parquet").write_bytes(b"half a file")
    same(batches.read_mart(spark, str(tmp_path), "orders"), good)
    assert batches.refresh_mart(good, str(tmp_path), "orders", "two")  # the failed batch can be loaded after all


def test_replaced_and_compacted_batches(make, spark, tmp_path):
    one, two, corrected = (make("orders", random_lines(s)) for s in (4, 5, 6))
    for name, rows in (("one", one), ("two", two)):
        batches.refresh_mart(rows, str(tmp_path), "orders", name)
    assert batches.refresh_mart(corrected, str(tmp_path), "orders", "two", replace=True)
    same(batches.read_mart(spark, str(tmp_path), "orders"), one.unionByName(corrected))
    batches.compact_mart(spark, str(tmp_path), "orders")
    same(batches.read_mart(spark, str(tmp_path), "orders"), one.unionByName(corrected))
    assert batches.current_loads(spark, str(tmp_path), "orders").select("load").distinct().count() == 1
    assert not batches.refresh_mart(two, str(tmp_path), "orders", "one")
    with pytest.raises(ValueError, match="compacted"):
        batches.refresh_mart(two, str(tmp_path), "orders", "one", replace=True)
    with pytest.raises(ValueError, match="nothing was loaded"):
        batches.read_mart(spark, str(tmp_path), "products")


def test_an_empty_batch(make, spark, tmp_path):
    batches.refresh_mart(make("orders", []), str(tmp_path), "orders", "none")
    assert batches.read_mart(spark, str(tmp_path), "orders").count() == 0
    batches.refresh_mart(make("orders", [line("o1", "a", "2022-01-01")]), str(tmp_path), "orders", "one")
    assert batches.read_mart(spark, str(tmp_path), "orders").count() == 1


def test_states_combine_to_any_grain(make):
    lines = make("orders", random_lines(7))
    fine = states.sales_states(lines, SALES_GRAIN)
    for dims in (["year", "category"], ["channel"], []):
        same(states.combined(fine, dims), states.sales_states(lines, dims))
    rows = records(states.combined(fine, ["category"]).withColumn("m", states.mean("discount")))
    exact = {r["category"]: r["m"] for r in records(lines.groupBy("category").agg(F.avg("discount_pct").alias("m")))}
    assert {r["category"]: r["m"] for r in rows} == pytest.approx(exact)


def test_sets_count_distinct_values_at_any_grain(spark):
    """Numbers beyond one bitmap, negative ones, NULL, and a hot group."""
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("a"), (F.col("id") % 4).alias("b"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 90_000 - 20).alias("x"), (F.hash("id") % 500).cast("bigint").alias("y"),
    )
    sets = states.distinct_states(rows, ["a", "b"], {"xs": "x", "ys": "y"})
    for dims in (["a", "b"], ["a"], ["b"], []):
        got = states.distinct_counts(sets, dims, ["xs", "ys"])
        same(got, rows.groupBy(*dims).agg(F.countDistinct("x").alias("xs"), F.countDistinct("y").alias("ys")))
        assert "Expand" not in plan(got)


def test_reports_from_states_read_no_lines(spark):
    for name in ("states_category_contribution", "states_channel_performance", "distinct_counts_by_grain", "incremental_channel_rollup", "incremental_cohorts"):
        text = plan(registry.QUERIES[name](spark, SMALL))
        assert "lineitem" not in text and "orders.parquet" not in text and "Expand" not in text.replace("ExpandMode", ""), name


def test_month_by_month_equals_all_at_once(make, spark, tmp_path):
    """Batches by month in any order, so that first orders come late; some are sent twice; then all are compacted."""
    rows = random_lines(11)
    rows += [line("o900", "hot", "2021-12-31"), line("o901", "hot", "2021-12-31", channel="Store"), line("o000x", "a", "2021-01-01", status="Cancelled")]
    lines = make("orders", rows)
    months = sorted({str(r["order_date"])[:7] for r in rows}, reverse=True)
    random.Random(11).shuffle(months)
    kept = Increments(spark, str(tmp_path))
    numbers = {order: n for n, order in enumerate(sorted({r["order_id"] for r in rows}))}
    buyers = {c: n for n, c in enumerate(sorted({r["customer_id"] for r in rows if r["customer_id"]}))}
    number = lambda table, column: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col(column)]
    for month in [*months, months[0]]:
        part = lines.filter(F.coalesce(F.date_format("order_date", "yyyy-MM"), F.lit("None")) == month)
        part = part.withColumns({"order_number": number(numbers, "order_id"), "customer_number": number(buyers, "customer_id")})
        added = [kept.add_months(month, part), kept.add_customers(month, part), kept.add_sales(month, part), kept.add_sets(month, part)]
        assert added == [True] * 4 or (month == months[0] and not any(added))
    for _ in range(2):
        same(kept.channel_monthly_rollup(), builders.channel_monthly_rollup(lines))
        same(kept.cohort_repeat_rate(), customers.cohort_repeat_rate(lines))
        same(kept.channel_performance(), sales.channel_performance(lines))
        same(kept.category_contribution(2023), sales.category_contribution(lines, 2023))
        kept.compact()
    assert kept.sets().count() == kept.sets().select(*SET_GRAIN, "kind", "bucket").distinct().count()


def test_several_batches_from_one_pass(make, spark, tmp_path, monkeypatch):
    """Batches by condition equal one by one; each is loaded from states that are kept, and lines are read once a mart."""
    rows = random_lines(13)
    lines = make("orders", rows).withColumns({"order_number": F.xxhash64("order_id") % 70_000, "customer_number": F.xxhash64("customer_id") % 500})
    day = F.col("order_date")
    parts = {"2022": F.year(day) == 2022, "2023": F.year(day) == 2023, "rest": ~F.year(day).isin(2022, 2023) | day.isNull()}
    one, several = Increments(spark, f"{tmp_path}/one"), Increments(spark, f"{tmp_path}/several")
    for name, condition in parts.items():
        assert one.add_sales(name, lines.filter(condition)) and one.add_sets(name, lines.filter(condition), buyer_number="customer_number")
    loaded, load = [], increments.refresh_mart
    monkeypatch.setattr(increments, "refresh_mart", lambda df, *rest: (loaded.append(plan(df)), load(df, *rest))[1])
    first = {"2023": parts["2023"]}
    assert several.add_sales_batches(first, lines) == several.add_sets_batches(first, lines, buyer_number="customer_number") == ["2023"]
    loaded.clear()
    assert several.add_sales_batches(parts, lines) == several.add_sets_batches(parts, lines, buyer_number="customer_number") == ["2022", "rest"]
    assert len(loaded) == 4 and all("ExistingRDD" in text and "Aggregate" not in text for text in loaded)
    assert several.add_sales_batches(parts, lines) == several.add_sets_batches(parts, lines) == several.missing("sets", list(parts)) == []
    same(several.channel_performance(), one.channel_performance())
    same(several.channel_performance(), sales.channel_performance(lines.drop("order_number", "customer_number")))
    same(several.distinct_by_grain(), one.distinct_by_grain())
    for mart in ("sales", "sets"):
        assert sorted(r["batch"] for r in batches.current_loads(spark, several.folder, mart).collect()) == sorted(parts)


def test_tasks_send_numbers_not_bitmaps(spark):
    """No task makes a bitmap of the few numbers it happens to have of each bucket."""
    rows = spark.range(1000, numPartitions=4).select((F.col("id") % 5).alias("a"), "id")
    text = plan(states.distinct_states(rows, ["a"], {"xs": "id"}))
    below = text[text.rindex("Exchange hashpartitioning"):]
    assert text.count("Exchange") == 1 and "bitmap_construct_agg" in text and "bitmap_construct_agg" not in below
