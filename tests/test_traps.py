"""Hand-made frames for the cases where a report's literal rules surprise."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from shelfwise.functions.numeric import ratio, rnd
from shelfwise.operators import (
    builders, customers, executive, inventory, marketing, pricing, quality, returns, sales, seasonality,
)

from .conftest import records


def day(text):
    return datetime.date.fromisoformat(text)


def test_rounding_tie_is_exact(spark):
    df = spark.sql("SELECT (146.84D + 114.69D) / 2 AS x, -2.675D AS y, CAST(NULL AS DOUBLE) AS z")
    assert records(df.select(rnd("x", 2).alias("x"), rnd("y", 2).alias("y"), rnd("z", 2).alias("z"))) == [
        {"x": 130.77, "y": -2.68, "z": None}
    ]


def test_ratio_by_zero_is_null(spark):
    assert spark.range(1).select(ratio(F.lit(1), F.lit(0))).first()[0] is None


def test_discount_bands_gaps(make):
    discounts = [0.0, 0.5, 10.0, 10.5, 20.0, 20.5, 30.0, 31.0]
    lines = make("orders", [{"discount_pct": d, "order_id": f"o{d}"} for d in discounts])
    literal = {r["discount_band"]: r["orders"] for r in records(pricing.discount_bands(lines))}
    assert literal == {"0% (No Discount)": 1, "1–10%": 1, "11–20%": 1, "21–30%": 1, "30%+": 4}
    closed = {r["discount_band"]: r["orders"] for r in records(pricing.discount_bands(lines, contiguous=True))}
    assert closed == {"0% (No Discount)": 1, "1–10%": 2, "11–20%": 2, "21–30%": 2, "30%+": 1}


def test_discount_bands_order_is_by_lowest_discount(make):
    lines = make("orders", [{"discount_pct": d} for d in (35.0, 15.0, 0.5, 0.0)])
    # 0.5 falls into the last band, which therefore sorts right after the first one.
    assert [r["discount_band"] for r in records(pricing.discount_bands(lines))] == ["0% (No Discount)", "30%+", "11–20%"]


@pytest.fixture()
def one_year_categories(make):
    rows = [("A", 2023, 100.0), ("A", 2024, 150.0), ("B", 2023, 80.0), ("C", 2024, 70.0)]
    return make("orders", [{"category": c, "year": y, "revenue_inr": v * 1e5} for c, y, v in rows])


def test_growth_keeps_categories_of_both_years(one_year_categories):
    assert records(sales.yoy_category_growth(one_year_categories)) == [
        {"category": "A", "rev_2023": 100.0, "rev_2024": 150.0, "yoy_growth_pct": 50.0, "units_2023": 1, "units_2024": 1}
    ]


def test_growth_pivot_fills_zero(one_year_categories):
    growth = sales.yoy_growth_pivot(one_year_categories)
    assert [(r["category"], r["growth_pct"]) for r in records(growth)] == [("B", -100.0), ("A", 50.0)]
    assert records(sales.yoy_extremes(growth)) == [{"fastest_growing": "A", "most_declining": "B"}]


def test_flat_group_has_no_correlation(make):
    lines = make("orders", [{"discount_pct": 10.0, "quantity": q} for q in (1, 2, 3)])
    assert records(pricing.price_elasticity_proxy(lines))[0]["discount_qty_correlation"] is None


def test_correlation_value(make):
    lines = make("orders", [{"discount_pct": d, "quantity": q} for d, q in ((0.0, 1), (10.0, 2), (20.0, 4))])
    assert records(pricing.price_elasticity_proxy(lines))[0]["discount_qty_correlation"] == 0.982


def rfm_lines(make):
    """c0 is newest, most frequent and pays most; c4 the opposite."""
    rows = []
    for k in range(5):
        for j in range(10 - k):
            rows.append({
                "customer_id": f"c{k}", "order_id": f"o{k}-{j}", "order_date": day(f"2024-0{6 - k}-01"),
                "revenue_inr": 1000.0 - 100 * k,
            })
    return make("orders", rows)


def test_rfm_literal_and_corrected(make):
    lines = rfm_lines(make)
    literal = {r["customer_id"]: r for r in records(customers.rfm_segmentation(lines, day("2024-07-01")))}
    assert (literal["c0"]["r_score"], literal["c0"]["f_score"], literal["c0"]["m_score"]) == (1, 1, 1)
    assert literal["c0"]["rfm_segment"] == "Lost" and literal["c4"]["rfm_segment"] == "Champion"
    assert literal["c0"]["recency_days"] == 30 and literal["c0"]["frequency"] == 10
    assert literal["c0"]["monetary"] == 10000.0
    fixed = {r["customer_id"]: r for r in records(customers.rfm_segmentation(lines, day("2024-07-01"), corrected=True))}
    assert fixed["c0"]["rfm_segment"] == "Champion" and fixed["c4"]["rfm_segment"] == "Lost"
    assert fixed["c4"]["monetary"] == literal["c4"]["monetary"]


def test_rfm_new_customer_is_hidden_unless_corrected(spark):
    df = spark.createDataFrame([(5, 1), (4, 1), (5, 2)], "r int, f int")
    r, f = F.col("r"), F.col("f")
    labels = [(x[0], x[1]) for x in df.select(customers.rfm_segment(r, f), customers.rfm_segment(r, f, True)).collect()]
    assert labels == [
        ("Potential Loyalist", "New Customer"), ("Potential Loyalist", "Potential Loyalist"),
        ("Potential Loyalist", "Potential Loyalist"),
    ]


def test_rolling_average_counts_rows_not_months(make):
    lines = make("orders", [{"month": m, "month_name": "x", "revenue_inr": v * 1e5} for m, v in ((1, 3), (2, 6), (4, 12))])
    rows = records(sales.rolling_ytd_revenue(lines))
    assert [r["rolling_3m_avg_lakhs"] for r in rows] == [3.0, 4.5, 7.0]
    assert [r["ytd_revenue_lakhs"] for r in rows] == [3.0, 9.0, 21.0]


def test_rolling_average_over_calendar_months(make):
    lines = make("orders", [{"month": m, "month_name": "x", "revenue_inr": v * 1e5} for m, v in ((1, 3), (2, 6), (4, 12))])
    rows = records(sales.rolling_ytd_revenue(lines, corrected=True))
    assert [r["rolling_3m_avg_lakhs"] for r in rows] == [3.0, 4.5, 9.0]


def test_order_value_per_order(make):
    lines = make("orders", [
        {"order_id": o, "selling_price": 10.0, "revenue_inr": v, "customer_id": "c1"} for o, v in (("o1", 30.0), ("o1", 50.0), ("o2", 20.0))
    ])
    base = make("customers", [{"customer_id": "c1", "city": "X", "city_tier": "T", "loyalty_segment": "Loyal"}])
    spend = make("marketing_spend", [])
    reports = [
        ("avg_order_value", lambda k: sales.monthly_revenue_mom(lines, corrected=k)),
        ("avg_order_value", lambda k: sales.channel_performance(lines, corrected=k)),
        ("avg_order_value", lambda k: sales.kpi_by_year(lines, (2024,), corrected=k)),
        ("avg_order_value", lambda k: customers.city_tier_mix(lines, base, corrected=k)),
        ("avg_basket_value", lambda k: customers.category_by_loyalty(lines, base, corrected=k)),
        ("aov_inr", lambda k: executive.executive_kpi(lines, spend, corrected=k)),
    ]
    for column, report in reports:
        assert [records(report(k))[0][column] for k in (False, True)] == [10.0, 50.0]


def test_skus_and_sku_sizes(make):
    stock = make("inventory", [
        {"product_id": p, "category": "A", "size": s, "stock_health_status": h}
        for p, s, h in (("p1", "S", "Stockout"), ("p1", "M", "Stockout"), ("p2", "S", "Low Stock"))
    ])
    literal, fixed = (records(inventory.inventory_health_by_category(stock, corrected=k))[0] for k in (False, True))
    assert (literal["stockout_skus"], fixed["stockout_skus"], fixed["low_stock_skus"], fixed["overstock_skus"]) == (2, 1, 1, 0)


def test_return_rates_differ(make):
    lines = make("orders", [{"is_returned": True}, {"is_returned": True}])
    assert records(returns.return_rate_category_channel(lines))[0]["return_rate_pct"] == 200.0
    assert records(returns.return_rate_matrix(lines, ["Web"]))[0]["Web"] == 100.0


def test_null_return_flag(make):
    lines = make("orders", [{"is_returned": None}, {"is_returned": True}])
    assert records(returns.return_rate_category_channel(lines))[0]["returned_orders"] == 1
    assert records(returns.overall_return_rate(lines)) == [{"return_rate_pct": 100.0}]


def test_top_products_without_stock_row(make):
    lines = make("orders", [
        {"product_id": "p1", "quantity": 5, "revenue_inr": 10.0}, {"product_id": "p2", "quantity": 1, "revenue_inr": 9000.0},
    ])
    catalogue = make("products", [{"product_id": p, "product_name": p} for p in ("p1", "p2", "p3")])
    stock = make("inventory", [
        {"product_id": "p1", "size": s, "sell_through_pct": t, "stock_health_status": h}
        for s, t, h in (("S", 10.0, "Stockout"), ("M", 70.0, "Healthy"))
    ])
    by_units = records(sales.top_products(lines, catalogue, stock))
    assert [r["product_id"] for r in by_units] == ["p1", "p2"]
    assert (by_units[0]["sell_through_pct"], by_units[0]["stock_status"]) == (70.0, "Stockout")
    assert by_units[1]["sell_through_pct"] is None
    urgent = records(sales.top_products(lines, catalogue, stock.replace("Stockout", "Low Stock"), corrected=True))
    assert [r["stock_status"] for r in urgent] == ["Low Stock", None]
    by_revenue = records(sales.top_products(lines, catalogue, stock, k=1, order_by="revenue"))
    assert [r["product_id"] for r in by_revenue] == ["p2"]


def test_duplicate_catalogue_rows_multiply_like_a_join(make):
    lines = make("orders", [{"quantity": 2}, {"quantity": 3}])
    catalogue = make("products", [{"product_id": "p1", "product_name": "x"}] * 2)
    stock = make("inventory", [])
    assert records(sales.top_products(lines, catalogue, stock))[0]["units_sold"] == 10
    assert records(sales.hero_skus(lines, catalogue))[0]["units"] == 10


def test_executive_year_without_marketing_and_tied_category(make):
    lines = make("orders", [
        {"year": 2022, "category": c, "order_id": o, "customer_id": k, "is_returned": r}
        for c, o, k, r in (("B", "o1", "c1", True), ("A", "o2", "c1", False), ("A", "o2", "c2", None), ("B", "o3", "c2", False))
    ] + [{"year": 2023, "order_status": "Cancelled"}])
    row, = records(executive.executive_kpi(lines, make("marketing_spend", [])))
    assert row["blended_roas"] is None and row["top_category_by_rev"] == "A"
    assert (row["total_orders"], row["unique_buyers"], row["orders_per_customer"]) == (3, 2, 1.5)
    assert (row["units_sold"], row["return_rate_pct"], row["aov_inr"]) == (4, 25.0, 100.0)


def test_executive_ignores_null_ids_but_not_a_missing_category(make):
    lines = make("orders", [{"order_id": None, "customer_id": None, "category": None}, {"category": "A", "revenue_inr": 1.0}])
    row, = records(executive.executive_kpi(lines, make("marketing_spend", [{"year": 2024, "spend_inr_lakhs": 0.0}])))
    assert (row["total_orders"], row["unique_buyers"], row["units_sold"]) == (1, 1, 2)
    assert row["top_category_by_rev"] is None and row["blended_roas"] is None


def test_kpi_growth_uses_the_calendar_year_before(make):
    lines = make("orders", [
        {"year": y, "revenue_inr": v, "order_status": s, "is_returned": r}
        for y, v, s, r in (
            (2020, 100000.0, "Delivered", False), (2021, 200000.0, "Delivered", False), (2021, 9.0, "Cancelled", True),
            (2023, 50000.0, "Delivered", False), (2024, 7.0, "Cancelled", False),
        )
    ])
    rows = {r["year"]: r for r in records(sales.kpi_by_year(lines, (2021, 2023, 2024, 2026)))}
    assert list(rows) == [2021, 2023, 2024, 2026]
    assert (rows[2021]["yoy_growth_pct"], rows[2021]["return_rate_pct"]) == (100.0, 50.0)
    assert rows[2023]["yoy_growth_pct"] == 0.0
    assert (rows[2024]["revenue_lakhs"], rows[2024]["yoy_growth_pct"], rows[2024]["total_orders"]) == (0.0, -100.0, 0)
    assert (rows[2026]["units_sold"], rows[2026]["yoy_growth_pct"], rows[2026]["return_rate_pct"]) == (0, None, None)


def test_size_curve_keeps_absent_sizes(make):
    stock = make("inventory", [{"product_id": "p", "size": "M", "units_sold": 3, "sell_through_pct": 50.0}])
    rows = records(inventory.size_curve(stock))
    assert [r["size"] for r in rows] == ["XS", "S", "M", "L", "XL", "XXL"]
    assert rows[0]["units_sold"] is None and rows[2]["units_sold"] == 3
    assert [r["size"] for r in rows if r["is_core"]] == ["M", "L"]


def test_loyalty_keeps_absent_segments(make):
    base = make("customers", [{"customer_id": "c", "loyalty_segment": "Champion", "total_spend_inr": 10.0, "total_orders": 2}])
    rows = records(customers.loyalty_breakdown(base))
    assert rows[0] == {"loyalty_segment": "Champion", "customers": 1, "avg_spend_inr": 10.0, "avg_orders": 2.0}
    assert rows[-1] == {"loyalty_segment": "Lost", "customers": 0, "avg_spend_inr": 0.0, "avg_orders": 0.0}


def test_seasonality_labels(make):
    lines = make("orders", [
        {"month": m, "month_name": n, "revenue_inr": v * 1e5} for m, n, v in ((1, "Jan", 8), (2, "Feb", 10), (3, "Mar", 13))
    ])
    assert [r["demand_label"] for r in records(seasonality.seasonality_index_avg(lines))] == ["Trough", "Normal", "Peak"]
    by_sum = seasonality.seasonality_index_sum(lines)
    assert [(r["month_name"], r["seasonality_index"]) for r in records(by_sum)] == [("Jan", 0.774), ("Feb", 0.968), ("Mar", 1.258)]
    assert records(seasonality.peak_months(by_sum)) == [{"peak_months": ["Mar"]}]


def test_reorder_priority_and_rounding_order(make):
    stock = make("inventory", [
        {"product_id": "p", "size": s, "closing_stock": c, "weeks_of_cover": w, "rate_of_sale_per_week": r, "reorder_recommended": f}
        for s, c, w, r, f in (("S", 5, 9.0, 0.3, True), ("M", 0, 0.0, 0.1, True), ("L", 1, 3.0, 0.2, True), ("XL", 9, 90.0, 0.1, False))
    ])
    rows = records(inventory.reorder_priority(stock, make("products", [{"product_id": "p", "cost_price": 100.0}])))
    assert [(r["size"], r["reorder_priority"]) for r in rows] == [("M", "P1 - Urgent"), ("L", "P2 - High"), ("S", "P3 - Medium")]
    assert (rows[2]["suggested_reorder_qty"], rows[2]["reorder_value_inr"]) == (2.0, 240.0)


def test_overstock_limits_are_strict(make):
    stock = make("inventory", [
        {"product_id": "p", "size": s, "weeks_of_cover": w, "sell_through_pct": t, "closing_stock": c, "stock_value_at_cost": 1000.0}
        for s, w, t, c in (("S", 16.0, 10.0, 50), ("M", 17.0, 30.0, 50), ("L", 17.0, 29.0, 20), ("XL", 17.0, 29.0, 21), ("XS", None, 0.0, 50))
    ])
    rows = records(inventory.overstock_alert(stock, make("products", [{"product_id": "p"}])))
    assert [(r["size"], r["potential_markdown_loss"]) for r in rows] == [("XL", 350.0)]


def test_channel_mix_counts_unlisted_channels_in_the_total(make):
    lines = make("orders", [{"channel": c, "revenue_inr": v} for c, v in (("Web", 3e5), ("Shop", 1e5))])
    row, = records(sales.channel_mix_pivot(lines, ["Web", "App"]))
    assert row == {"year": 2024, "Web": 3.0, "App": 0.0, "Other": 1.0, "Web_share_pct": 75.0, "App_share_pct": 0.0, "Other_share_pct": 25.0}


def test_marketing_tiers(make):
    spend = make("marketing_spend", [
        {"year": 2024, "marketing_channel": c, "spend_inr_lakhs": 1.0, "attributed_revenue_lakhs": r}
        for c, r in (("a", 2.99), ("b", 3.0), ("c", 4.5))
    ])
    roi = marketing.marketing_roi_year(spend)
    assert [(r["tier"], r["below_floor"]) for r in records(roi)] == [("<3", True), ("3–4.5", False), ("≥4.5", False)]
    assert records(marketing.best_roas_channel(roi)) == [{"best_channel": "c", "best_roas": 4.5}]


def test_new_and_repeat_orders(make):
    rows = [("c1", "o2", "2024-01-05"), ("c1", "o1", "2024-01-05"), ("c1", "o3", "2024-01-09"), ("c2", "o4", "2024-01-01")]
    lines = make("orders", [{"customer_id": c, "order_id": o, "order_date": day(d)} for c, o, d in rows])
    row, = records(builders.channel_monthly_rollup(lines))
    assert (row["total_orders"], row["new_customer_orders"], row["repeat_customer_orders"]) == (4, 2, 2)


def test_customer_master_modes_and_missing_customers(make):
    rows = [("o1", "B", "S"), ("o1", "A", "S"), ("o2", "B", None), ("o3", "A", "M")]
    lines = make("orders", [{"order_id": o, "category": c, "size": s} for o, c, s in rows])
    base = make("customers", [{"customer_id": c} for c in ("c1", "c9")])
    by_id = {r["customer_id"]: r for r in records(builders.customer_master(base, lines))}
    known = by_id["c1"]
    assert (known["total_orders"], known["total_spend_inr"], known["avg_order_value"]) == (3, 400.0, 400.0 / 3)
    assert (known["preferred_category"], known["preferred_size"]) == ("A", "S")
    assert (by_id["c9"]["total_orders"], by_id["c9"]["avg_order_value"]) == (0, None)


def test_snapshot_statuses(make, spark):
    stock = spark.createDataFrame(
        [("p", s, "A", "T", 100.0, 40.0, o, 0) for s, o in (("S", 5), ("M", 100), ("L", 100), ("XL", 10))],
        "product_id string, size string, category string, product_type string, mrp double, cost_price double, "
        "opening_stock bigint, units_received bigint",
    )
    lines = make("orders", [
        {"product_id": "p", "size": s, "quantity": q, "order_date": day(d)}
        for s, q, d in (("S", 9, "2024-02-01"), ("M", 10, "2024-02-01"), ("M", 50, "2024-01-01"), ("XL", 6, "2024-02-10"))
    ])
    snap = builders.inventory_snapshot(stock, lines, as_of=day("2024-02-10"), since=day("2024-01-01"), weeks=10)
    got = {r["size"]: (r["units_sold"], r["closing_stock"], r["stock_health_status"], r["reorder_recommended"]) for r in records(snap)}
    assert got == {
        "S": (5, 0, "Stockout", True), "M": (10, 90, "Overstocked", False),
        "L": (0, 100, "Overstocked", False), "XL": (6, 4, "Low Stock", True),
    }
    assert {r["size"]: r["weeks_of_cover"] for r in records(snap)}["L"] is None


def test_checks(make):
    lines = make("orders", [{"customer_id": c} for c in ("c1", "c1", "x", None)])
    base = make("customers", [{"customer_id": c} for c in ("c1", "c1", "c2")])
    assert records(quality.referential_check(lines, base, "customer_id")) == [
        {"checked_rows": 4, "null_key_rows": 1, "orphan_rows": 1, "orphan_keys": 1}
    ]
    assert records(quality.key_uniqueness_check(base, ["customer_id"])) == [{"customer_id": "c1", "row_count": 2}]
    catalogue = make("products", [{"product_id": str(m), "mrp": 100.0, "cost_price": 40.0, "gross_margin_pct": m} for m in (60.0, 61.0)])
    assert records(quality.margin_identity_check(catalogue)) == [{"checked_rows": 2, "mismatches": 1, "max_difference": 1.0}]
    spend = make("marketing_spend", [{"roas": 2.0, "attributed_revenue_lakhs": 2.004, "spend_inr_lakhs": 1.0}])
    assert records(quality.roas_identity_check(spend))[0]["mismatches"] == 0
