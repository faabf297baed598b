"""Tables of the model built from raw order lines: stock snapshot, customer master, channel months."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.domains import LOW_STOCK, OVERSTOCKED, SIZES, STOCKOUT
from ..functions.measures import time_dims
from ..functions.numeric import count_where, first_largest, lakhs, pct, ratio, rnd


def stock_grid(products: DataFrame, sizes: Sequence[str] = SIZES) -> DataFrame:
    """Each product once per size: an explode over the fixed size list, not a cross join."""
    return products.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))


def inventory_snapshot(
    stock: DataFrame, lines: DataFrame, as_of: datetime.date, since: datetime.date, weeks: int,
    low_woc: float = 26, over_st: float = 30, healthy_st: float = 60,
) -> DataFrame:
    """Stock position of every product and size at ``as_of``.

    ``stock`` is a ``stock_grid`` of the catalogue with ``opening_stock`` and ``units_received``;
    ``lines`` hold the demand in (``since``, ``as_of``], a period of ``weeks`` weeks. Lines are summed
    per product and size before the join, so a best seller weighs one row in it.
    """
    demand = (
        lines.filter((F.col("order_date") > F.lit(since)) & (F.col("order_date") <= F.lit(as_of)))
        .groupBy("product_id", "size").agg(F.sum("quantity").alias("demand"))
    )
    available = F.col("opening_stock") + F.col("units_received")
    wanted = F.coalesce("demand", F.lit(0))
    position = (
        stock.join(demand, ["product_id", "size"], "left")
        .withColumn("units_sold", F.least(wanted, available))
        .withColumn("closing_stock", F.greatest(available - wanted, F.lit(0)))
        .withColumn("sell_through_pct", ratio(F.col("units_sold") * 100.0, available))
        .withColumn("rate_of_sale_per_week", F.col("units_sold") / float(weeks))
        .withColumn("weeks_of_cover", ratio("closing_stock", "rate_of_sale_per_week"))
    )
    out_of_stock = F.col("closing_stock") == 0
    health = (
        F.when(out_of_stock, STOCKOUT)
        .when(F.col("weeks_of_cover") < low_woc, LOW_STOCK)
        .when(F.col("sell_through_pct") < over_st, OVERSTOCKED)
        .when(F.col("sell_through_pct") >= healthy_st, "Healthy")
        .otherwise("Normal")
    )
    return position.select(
        "product_id", "category", "product_type", "size", "opening_stock", "units_received", "units_sold",
        "closing_stock", "sell_through_pct", "rate_of_sale_per_week", "weeks_of_cover",
        health.alias("stock_health_status"),
        (out_of_stock | F.coalesce(F.col("weeks_of_cover") < low_woc, F.lit(False))).alias("reorder_recommended"),
        (F.col("closing_stock") * F.col("cost_price")).alias("stock_value_at_cost"),
        (F.col("closing_stock") * F.col("mrp")).alias("stock_value_at_mrp"),
    )


def customer_master(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers with lifetime orders, spend, order value, preferred category and size.

    Preferred = on most lines, the alphabetically first one on a tie. One pass over the lines: each is
    counted under its order, its category and its size. The counts combine map-side and shuffle by
    (customer, value), so a customer with very many lines is spread over tasks.
    """
    order, category, size = 0, 1, 2
    facets = F.array(F.lit(None).cast("string"), F.col("category"), F.col("size"))
    facet = F.col("facet")
    counted = (
        orders.select("customer_id", "order_id", "revenue_inr", F.posexplode(facets).alias("facet", "name"))
        .groupBy("customer_id", "facet", "name", F.when(facet == order, F.col("order_id")).alias("order_id"))
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("revenue_inr").alias("revenue"))
    )
    named = F.when(F.col("name").isNotNull(), F.col("lines"))
    lifetime = counted.groupBy("customer_id").agg(
        F.count("order_id").alias("total_orders"),
        F.sum(F.when(facet == order, F.col("revenue"))).alias("total_spend_inr"),
        first_largest(F.when(facet == category, named), "name").alias("preferred_category"),
        first_largest(F.when(facet == size, named), "name").alias("preferred_size"),
    )
    derived = [c for c in lifetime.columns if c != "customer_id"] + ["avg_order_value"]
    return (
        customers.drop(*derived)
        .join(lifetime, "customer_id", "left")
        .fillna({"total_orders": 0, "total_spend_inr": 0.0})
        .withColumn("avg_order_value", ratio("total_spend_inr", "total_orders"))
    )


def channel_monthly_rollup(orders: DataFrame) -> DataFrame:
    """Month and channel: GMV before discount, net revenue, orders (new and repeat), returns, discounts.

    A customer's earliest order (lowest id on the same day) is new in its month and channel, all others are
    repeat orders. The earliest order is an aggregate, not a window over the lines of a customer, so
    a customer with very many lines stays spread over tasks; new orders are counted from it
    directly and join as one row per month and channel.
    """
    # Lines are read and shuffled once, to a row per order (and customer, day, channel); both results come from that.
    placed = per_order(orders)
    return rollup_report(month_totals(placed), first_orders(placed))


MONTH_SUMS = ("gmv", "net", "units_sold", "lines", "returned")


def per_order(orders: DataFrame) -> DataFrame:
    """Lines summed to a row per order (and customer, day, channel)."""
    return orders.groupBy(
        F.trunc("order_date", "month").alias("month_start_date"), "channel", "order_id", "customer_id", "order_date"
    ).agg(
        F.sum(F.col("mrp") * F.col("quantity")).alias("gmv"), F.sum("revenue_inr").alias("net"),
        F.sum("quantity").alias("units_sold"), F.count(F.lit(1)).alias("lines"), count_where(F.col("is_returned")).alias("returned"),
    )


def month_totals(placed: DataFrame) -> DataFrame:
    """Sums and number of orders per month and channel, from ``per_order``."""
    return placed.groupBy("month_start_date", "channel").agg(
        F.countDistinct("order_id").alias("total_orders"), *[F.sum(n).alias(n) for n in MONTH_SUMS]
    )


def first_orders(placed: DataFrame) -> DataFrame:
    """Each customer's earliest order, lowest id on the same day, as a struct ``first``, from ``per_order``."""
    known = F.col("customer_id").isNotNull() & F.col("order_date").isNotNull() & F.col("order_id").isNotNull()
    # The sums stay in the row, so that Spark finds the same exchange below this and the totals.
    order = F.struct("order_date", "order_id", "channel", "month_start_date", *MONTH_SUMS)
    return placed.groupBy("customer_id").agg(F.min(F.when(known, order)).alias("first")).filter("first is not null")


def rollup_report(totals: DataFrame, earliest: DataFrame) -> DataFrame:
    """``channel_monthly_rollup`` from the months' totals and the customers' earliest orders."""
    dims = ["month_start_date", "channel"]
    new = earliest.groupBy("first.month_start_date", "first.channel").agg(F.countDistinct("first.order_id").alias("new_customer_orders"))
    same = [totals[d].eqNullSafe(new[d]) for d in dims]
    months = totals.join(new, same, "left").drop(*[new[d] for d in dims]).fillna(0, ["new_customer_orders"])
    return time_dims(months, "month_start_date").select(
        F.col("month_start_date").alias("date"), "year", "month", "month_name", "quarter", "channel",
        lakhs("gmv").alias("gmv_lakhs"),
        lakhs("net").alias("net_revenue_lakhs"),
        "total_orders",
        rnd(ratio("net", "total_orders"), 0).alias("avg_order_value_inr"),
        "units_sold",
        "new_customer_orders",
        (F.col("total_orders") - F.col("new_customer_orders")).alias("repeat_customer_orders"),
        pct("returned", "lines").alias("return_rate_pct"),
        pct(F.col("gmv") - F.col("net"), "gmv").alias("discount_rate_pct"),
        rnd(ratio("units_sold", "total_orders"), 2).alias("avg_items_per_order"),
    ).orderBy("date", "channel")
