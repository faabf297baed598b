"""Missing keys and unlisted values where they weigh most, and golden rows of the rules."""

from __future__ import annotations

import datetime

import pytest

from shelfwise.operators import customers, executive, inventory, marketing, pricing, returns, sales, seasonality
from shelfwise.operators.customers import rfm_segment

from .conftest import records


@pytest.fixture()
def lines(make):
    return make("orders", [
        {"order_id": "o1", "category": "A", "channel": "Amazon", "revenue_inr": 900.0, "year": 2023, "is_returned": True},
        {"order_id": "o2", "category": "A", "channel": "NewChannel", "revenue_inr": 40.0, "year": 2024},
        {"order_id": "o3", "category": None, "channel": None, "revenue_inr": 5000.0, "year": 2023},
        {"order_id": "o4", "category": None, "channel": "Amazon", "revenue_inr": 9000.0, "year": 2024},
        {"order_id": "o5", "category": "B", "channel": "Amazon", "revenue_inr": 60.0, "year": 2024},
    ])


def test_channel_mix_keeps_unlisted_channels(lines):
    rows = {r["year"]: r for r in records(sales.channel_mix_pivot(lines, ["Amazon", "Myntra"]))}
    assert rows[2024]["Other"] == pytest.approx(40 / 1e5) and rows[2024]["Other_share_pct"] == pytest.approx(100 * 40 / 9100)
    assert rows[2023]["Amazon_share_pct"] == 100.0 and rows[2023]["Myntra"] == 0.0
    present = sales.channel_mix_pivot(lines)
    assert present.columns == ["year", "Amazon", "NewChannel", "Amazon_share_pct", "NewChannel_share_pct"]
    assert {r["year"]: r["NewChannel"] for r in records(present)} == {2023: 0.0, 2024: pytest.approx(40 / 1e5)}


def test_return_rates_keep_unlisted_channels(lines):
    listed = {r["category"]: r for r in records(returns.return_rate_matrix(lines, ["Amazon"]))}
    assert listed.keys() == {"A", "B"}
    assert (listed["A"]["Amazon"], listed["A"]["Other"], listed["B"]["Other"]) == (100.0, 0.0, None)
    assert returns.return_rate_matrix(lines).columns == ["category", "Amazon", "NewChannel"]


def test_missing_category_is_the_best_of_the_executive_report(lines, make):
    top = {r["year"]: r["top_category_by_rev"] for r in records(executive.executive_kpi(lines, make("marketing_spend", [])))}
    assert top == {2023: None, 2024: None}


def test_missing_names_are_never_the_best_finding(lines, make):
    spend = make("marketing_spend", [
        {"marketing_channel": None, "spend_inr_lakhs": 1.0, "attributed_revenue_lakhs": 99.0},
        {"marketing_channel": "Email", "spend_inr_lakhs": 1.0, "attributed_revenue_lakhs": 2.0},
    ])
    row, = records(executive.findings_summary(lines, make("inventory", []), make("customers", []), spend))
    assert (row["best_category"], row["best_channel"], row["best_roas_channel"]) == ("A", "Amazon", "Email")
    assert row["blended_roas"] == 2.0 and row["total_revenue_lakhs"] == 0.2


def test_year_growth_leaves_out_missing_categories(lines):
    assert [r["category"] for r in records(sales.yoy_category_growth(lines, (2023, 2024)))] == ["A"]
    assert {r["category"] for r in records(sales.yoy_growth_pivot(lines, (2023, 2024)))} == {"A"}


def test_reports_that_group_like_the_notebook_leave_out_missing_keys(lines, make):
    assert {r["category"] for r in records(sales.category_revenue_margin(lines))} == {"A", "B"}
    assert {(r["category"], r["channel"]) for r in records(pricing.discount_margin_quadrants(lines))} == {("A", "Amazon"), ("A", "NewChannel"), ("B", "Amazon")}
    assert seasonality.seasonality_index_sum(make("orders", [{"month": None}, {"month": 2}])).count() == 1
    stock = make("inventory", [{"category": None, "product_type": "Hoodie", "sell_through_pct": 5.0}, {"category": "A", "product_type": "Hoodie"}])
    assert [r["category"] for r in records(inventory.sell_through_matrix(stock))] == ["A"]
    spend = make("marketing_spend", [{"year": 2024, "marketing_channel": None, "spend_inr_lakhs": 9.0}, {"year": 2024, "marketing_channel": "Email"}])
    assert [r["marketing_channel"] for r in records(marketing.marketing_roi_year(spend, 2024))] == ["Email"]


def test_reports_that_group_like_sql_keep_missing_keys(lines):
    assert None in {r["category"] for r in records(sales.category_contribution(lines, 2024))}
    assert None in {r["channel"] for r in records(sales.channel_performance(lines))}
    assert None in {r["category"] for r in records(returns.return_rate_category_channel(lines))}


@pytest.mark.parametrize("r, f, label, corrected", [
    (5, 5, "Champion", "Champion"), (4, 4, "Champion", "Champion"), (3, 3, "Loyal", "Loyal"), (5, 3, "Loyal", "Loyal"),
    (5, 1, "Potential Loyalist", "New Customer"), (4, 2, "Potential Loyalist", "Potential Loyalist"), (2, 3, "At Risk", "At Risk"),
    (1, 5, "At Risk", "At Risk"), (1, 1, "Lost", "Lost"), (1, 2, "Lost", "Lost"), (2, 1, "Needs Attention", "Needs Attention"),
    (3, 2, "Needs Attention", "Needs Attention"),
])
def test_golden_segments(spark, r, f, label, corrected):
    df = spark.createDataFrame([(r, f)], "r bigint, f bigint")
    assert df.select(rfm_segment(df.r, df.f).alias("a"), rfm_segment(df.r, df.f, corrected=True).alias("b")).first() == (label, corrected)


def test_golden_overstock_and_reorder(make):
    products = make("products", [{"product_id": p, "product_name": p, "category": "A", "cost_price": 100.0} for p in ("p1", "p2", "p3", "p4")])
    stock = make("inventory", [
        {"product_id": "p1", "size": "M", "closing_stock": 21, "sell_through_pct": 29.9, "weeks_of_cover": 16.1, "rate_of_sale_per_week": 1.3, "stock_value_at_cost": 2100.0},
        {"product_id": "p2", "size": "M", "closing_stock": 20, "sell_through_pct": 29.9, "weeks_of_cover": 16.1, "stock_value_at_cost": 9000.0},
        {"product_id": "p3", "size": "M", "closing_stock": 90, "sell_through_pct": 30.0, "weeks_of_cover": 99.0, "stock_value_at_cost": 9000.0},
        {"product_id": "p4", "size": "M", "closing_stock": 90, "sell_through_pct": 1.0, "weeks_of_cover": 16.0, "stock_value_at_cost": 9000.0},
    ])
    dead, = records(inventory.overstock_alert(stock, products))
    assert (dead["product_id"], dead["potential_markdown_loss"], dead["action_flag"]) == ("p1", 735.0, "Clearance Recommended")
    wanted = make("inventory", [
        {"product_id": "p1", "size": "M", "closing_stock": 0, "weeks_of_cover": 0.0, "rate_of_sale_per_week": 1.3, "reorder_recommended": True},
        {"product_id": "p2", "size": "M", "closing_stock": 5, "weeks_of_cover": 3.9, "rate_of_sale_per_week": 1.28, "reorder_recommended": True},
        {"product_id": "p3", "size": "M", "closing_stock": 5, "weeks_of_cover": 4.0, "rate_of_sale_per_week": 1.25, "reorder_recommended": True},
        {"product_id": "p4", "size": "M", "closing_stock": 5, "weeks_of_cover": 1.0, "rate_of_sale_per_week": 5.0, "reorder_recommended": False},
    ])
    rows = [(r["product_id"], r["reorder_priority"], r["suggested_reorder_qty"], r["reorder_value_inr"]) for r in records(inventory.reorder_priority(wanted, products))]
    assert rows == [("p1", "P1 - Urgent", 10.0, 1040.0), ("p2", "P2 - High", 10.0, 1024.0), ("p3", "P3 - Medium", 10.0, 1000.0)]


def test_golden_season_labels(make):
    months = [("Jan", 1, 121000.0), ("Feb", 2, 80000.0), ("Mar", 3, 99000.0)]
    lines = make("orders", [{"month": m, "month_name": name, "revenue_inr": v} for name, m, v in months])
    rows = [(r["month"], r["seasonality_index"], r["demand_label"]) for r in records(seasonality.seasonality_index_avg(lines))]
    assert rows == [(1, 1.21, "Peak"), (2, 0.8, "Trough"), (3, 0.99, "Normal")]


def test_cancelled_lines_are_not_dispatched(spark, tmp_path):
    """Stock counts what left the store: moving an order to cancelled gives its units back."""
    from shelfwise.plans.canonical import STOCK_AS_OF, CanonicalModel

    day = datetime.datetime.combine(STOCK_AS_OF, datetime.time()) - datetime.timedelta(days=30)
    part = spark.createDataFrame([(1, "n", "t", "b", 10, 50.0)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double")
    item = spark.createDataFrame(
        [(o, 1, 1, 1, 3.0, 30.0, 0.0, 0.0, "N", day) for o in (1, 2)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_shipdate timestamp_ntz",
    )
    orders = spark.createDataFrame(
        [(1, 1, "F", 1.0, day, "x"), (2, 1, "O", 1.0, day, "x")],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    )
    for name, df in (("part", part), ("lineitem", item), ("orders", orders)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    stock = CanonicalModel(spark, str(tmp_path)).inventory
    assert {r["size"]: r["units_sold"] for r in records(stock)}["XS"] == 3
