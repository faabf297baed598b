"""Leadership views: yearly KPIs, the dashboard and the summary of findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.domains import OVERSTOCKED
from ..functions.numeric import count_where, first_largest, lakhs, pct, ratio, rnd
from ..sources.loader import delivered
from .sales import kpi_by_year


def executive_kpi(orders: DataFrame, marketing: DataFrame, corrected: bool = False) -> DataFrame:
    """One row per year: revenue, orders, margin, returns, buyers, marketing ROAS, best category.

    The return rate counts delivered lines only. The lines are read once and counted under three facets:
    orders and buyers of a year are the groups of the first two, whose rows carry no sums; everything else folds up
    from the categories. Marketing joins as one row per year, so no row is multiplied. ``aov_inr`` is the mean
    line price, with ``corrected`` revenue per order. Lines without a category are a category, and the best
    one is NULL where they have the highest revenue.
    """
    facets = {"order_id": 0, "customer_id": 1, "category": 2}
    facet = F.col("facet")
    in_facet = {c: F.when(facet == i, F.col(c)).alias(c) for c, i in facets.items()}

    def in_category_facet(value):
        return F.when(facet == facets["category"], value)

    sums = {
        "revenue": F.sum(in_category_facet(F.col("revenue_inr"))),
        "price": F.sum(in_category_facet(F.col("selling_price"))),
        "price_n": F.count(in_category_facet(F.col("selling_price"))),
        "margin": F.sum(in_category_facet(F.col("gross_margin_pct"))),
        "margin_n": F.count(in_category_facet(F.col("gross_margin_pct"))),
        "discount": F.sum(in_category_facet(F.col("discount_pct"))),
        "discount_n": F.count(in_category_facet(F.col("discount_pct"))),
        "units_sold": F.sum(in_category_facet(F.col("quantity"))),
        "returned": count_where(in_category_facet(F.col("is_returned"))),
        "lines": count_where(facet == facets["category"]),
    }
    folded = (
        delivered(orders)
        .withColumn("facet", F.explode(F.array(*[F.lit(i) for i in facets.values()])))
        .groupBy("year", "facet", *in_facet.values())
        .agg(*[c.alias(n) for n, c in sums.items()])
        .groupBy("year", "facet", "category")
        .agg(
            F.count("order_id").alias("total_orders"), F.count("customer_id").alias("unique_buyers"),
            *[F.sum(n).alias(n) for n in sums],
        )
    )
    in_category = facet == facets["category"]
    yearly = folded.groupBy("year").agg(
        F.sum("total_orders").alias("total_orders"),
        F.sum("unique_buyers").alias("unique_buyers"),
        first_largest(F.when(in_category, F.col("revenue")), "category").alias("top_category_by_rev"),
        *[F.sum(F.when(in_category, F.col(n))).alias(n) for n in sums],
    )
    spend = marketing.groupBy("year").agg(
        rnd(ratio(F.sum("attributed_revenue_lakhs"), F.sum("spend_inr_lakhs")), 2).alias("blended_roas")
    )
    return (
        yearly.join(spend, "year", "left")
        .select(
            "year",
            lakhs("revenue").alias("net_revenue_lakhs"),
            "total_orders",
            rnd(ratio("revenue", "total_orders") if corrected else ratio("price", "price_n"), 0).alias("aov_inr"),
            rnd(ratio("margin", "margin_n"), 1).alias("avg_gross_margin_pct"),
            rnd(ratio("discount", "discount_n"), 1).alias("avg_discount_pct"),
            "units_sold",
            pct("returned", "lines").alias("return_rate_pct"),
            "unique_buyers",
            rnd(ratio("total_orders", "unique_buyers"), 2).alias("orders_per_customer"),
            "blended_roas", "top_category_by_rev",
        )
        .orderBy("year")
    )


def executive_dashboard(orders: DataFrame, years: Sequence[int] = (2022, 2023, 2024)) -> DataFrame:
    """Seven KPIs of each year in long form (metric, year, value)."""
    metrics = [
        "revenue_lakhs", "total_orders", "avg_order_value", "gross_margin_pct", "avg_discount_pct",
        "return_rate_pct", "unique_buyers",
    ]
    kpis = kpi_by_year(orders, years, growth=False).select("year", *[F.col(m).cast("double").alias(m) for m in metrics])
    return kpis.unpivot("year", metrics, "metric", "value").select("metric", "year", "value")


def findings_summary(
    orders: DataFrame, inventory: DataFrame, customers: DataFrame, marketing: DataFrame,
) -> DataFrame:
    """One row with the headline numbers of the four areas.

    Each source is read once and reduced to one row; the four rows are stacked and folded into one
    (MAX skips the NULLs of the other areas). What has no name is never the best.
    """
    # Revenue by category and by channel from one pass: (category, channel) sums, seen from both sides.
    sides = F.array(
        F.struct(F.lit("category").alias("side"), F.col("category").alias("name")),
        F.struct(F.lit("channel").alias("side"), F.col("channel").alias("name")),
    )
    revenue = (
        delivered(orders).groupBy("category", "channel").agg(F.sum("revenue_inr").alias("revenue"))
        .select(F.inline(sides), "revenue")
        .groupBy("side", "name").agg(F.sum("revenue").alias("revenue"))
    )
    of_category, of_channel = (F.when(F.col("side") == s, F.col("revenue")) for s in ("category", "channel"))
    named = F.col("name").isNotNull()
    sales = revenue.agg(
        lakhs(F.sum(of_category), 1).alias("total_revenue_lakhs"),
        first_largest(F.when(named, of_category), "name").alias("best_category"),
        first_largest(F.when(named, of_channel), "name").alias("best_channel"),
    )
    stock = inventory.agg(
        rnd(F.avg("sell_through_pct"), 1).alias("avg_sell_through_pct"),
        pct(count_where(F.col("stock_health_status") == OVERSTOCKED), F.count(F.lit(1))).alias("overstock_pct"),
        count_where(F.col("reorder_recommended")).alias("reorder_flags"),
    )
    base = customers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        pct(count_where(F.col("loyalty_segment") == "Champion"), F.count(F.lit(1))).alias("champion_pct"),
    )
    media = (
        marketing.dropna(subset=["marketing_channel"]).groupBy("marketing_channel")
        .agg(F.sum("attributed_revenue_lakhs").alias("revenue"), F.sum("spend_inr_lakhs").alias("spend"))
        .agg(
            rnd(ratio(F.sum("revenue"), F.sum("spend")), 2).alias("blended_roas"),
            first_largest(ratio("revenue", "spend"), "marketing_channel").alias("best_roas_channel"),
        )
    )
    rows = [sales, stock, base, media]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(c).alias(c) for df in rows for c in df.columns])
