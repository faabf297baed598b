"""Revenue trends, category and channel mix, best sellers, growth.

Windows here run over aggregates bounded by the calendar or by the category and channel lists,
never over order lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domains import (
    DELIVERED, FESTIVE_MONTHS, QUARTERS, SALE_MONTHS, columns_for, domain_frame, most_urgent,
)
from ..functions.numeric import (
    RUPEES_PER_THOUSAND, count_where, first_largest, first_smallest, growth_pct, lakhs, pct, ratio, rnd,
)
from ..sources.loader import delivered

MONTH = ("year", "month", "month_name")


def order_value(corrected: bool) -> Column:
    """Aggregate: what the reports call average order value, the mean price of a line.

    ``corrected`` is revenue per order.
    """
    if corrected:
        return rnd(ratio(F.sum("revenue_inr"), F.countDistinct("order_id")), 0)
    return rnd(F.avg("selling_price"), 0)


def monthly_revenue_mom(orders: DataFrame, status: str = DELIVERED, corrected: bool = False) -> DataFrame:
    """Revenue, orders and order value per month, with the change from the month before.

    The change is taken from the rounded revenues shown next to it. ``corrected``: see ``order_value``.
    """
    calendar = Window.orderBy("year", "month")
    return (
        delivered(orders, status).groupBy(*MONTH)
        .agg(
            lakhs(F.sum("revenue_inr")).alias("revenue_lakhs"),
            F.countDistinct("order_id").alias("total_orders"),
            order_value(corrected).alias("avg_order_value"),
        )
        .withColumn("prev_month_revenue", F.lag("revenue_lakhs").over(calendar))
        .withColumn("mom_growth_pct", growth_pct("revenue_lakhs", "prev_month_revenue"))
        .orderBy("year", "month")
        .drop("month")
    )


def category_contribution(orders: DataFrame, year: int = 2024) -> DataFrame:
    """Orders, units, revenue, profit, weighted margin and revenue share per category in one year."""
    return contribution_report(
        delivered(orders).filter(F.col("year") == year).groupBy("category")
        .agg(
            F.countDistinct("order_id").alias("total_orders"),
            F.sum("quantity").alias("units_sold"),
            F.sum("revenue_inr").alias("revenue"),
            F.sum("gross_profit_inr").alias("profit"),
            rnd(F.avg("discount_pct"), 1).alias("avg_discount_pct"),
        )
    )


def contribution_report(per_category: DataFrame) -> DataFrame:
    """``category_contribution`` from the year's sums per category."""
    everything = Window.partitionBy()
    return per_category.select(
        "category", "total_orders", "units_sold",
        lakhs("revenue").alias("revenue_lakhs"),
        lakhs("profit").alias("gross_profit_lakhs"),
        pct("profit", "revenue").alias("gross_margin_pct"),
        pct("revenue", F.sum("revenue").over(everything)).alias("revenue_share_pct"),
        "avg_discount_pct",
    ).orderBy(F.desc("revenue_lakhs"), "category")


def top_products(
    orders: DataFrame, products: DataFrame, inventory: DataFrame, k: int = 20, order_by: str = "units",
    corrected: bool = False,
) -> DataFrame:
    """The ``k`` best sellers by ``units`` or ``revenue``, with sell-through and stock status.

    Lines and stock are reduced to one row per product before the joins: no fan-out, and a product that
    holds a third of all lines is a single row when it is joined. ``stock_status`` is the
    alphabetically last status over the sizes, with ``corrected`` the most urgent one.
    """
    sums = {
        "units_sold": F.sum("quantity"),
        "revenue": F.sum("revenue_inr"),
        "margin_sum": F.sum("gross_margin_pct"),
        "margin_n": F.count("gross_margin_pct"),
        "discount_sum": F.sum("discount_pct"),
        "discount_n": F.count("discount_pct"),
    }
    sold = delivered(orders).groupBy("product_id").agg(*[c.alias(n) for n, c in sums.items()])
    status = most_urgent("stock_health_status") if corrected else F.max("stock_health_status")
    stock = inventory.groupBy("product_id").agg(
        F.max("sell_through_pct").alias("sell_through_pct"), status.alias("stock_status")
    )
    attributes = ["product_id", "product_name", "category", "product_type", "gender", "mrp"]
    key = {"units": F.desc("units_sold"), "revenue": F.desc("revenue")}[order_by]
    return (
        sold.join(products.select(*attributes), "product_id")
        .join(stock, "product_id", "left")
        .groupBy(*attributes, "sell_through_pct", "stock_status").agg(*[F.sum(n).alias(n) for n in sums])
        .orderBy(key, "product_id")
        .limit(k)
        .select(
            *attributes, "units_sold",
            rnd(F.col("revenue") / RUPEES_PER_THOUSAND, 1).alias("revenue_thousands"),
            rnd(ratio("margin_sum", "margin_n"), 1).alias("avg_margin_pct"),
            rnd(ratio("discount_sum", "discount_n"), 1).alias("avg_discount_pct"),
            "sell_through_pct", "stock_status",
        )
    )


def channel_performance(orders: DataFrame, corrected: bool = False) -> DataFrame:
    """Orders, units, revenue, price, discount, weighted margin and share of the year, per channel and year.

    ``corrected``: see ``order_value``.
    """
    return channel_report(
        delivered(orders).groupBy("channel", "year")
        .agg(
            F.countDistinct("order_id").alias("total_orders"),
            F.sum("quantity").alias("units_sold"),
            F.sum("revenue_inr").alias("revenue"),
            F.sum("gross_profit_inr").alias("profit"),
            order_value(corrected).alias("avg_order_value"),
            rnd(F.avg("discount_pct"), 1).alias("avg_discount_pct"),
        )
    )


def channel_report(per_channel: DataFrame) -> DataFrame:
    """``channel_performance`` from the sums per channel and year."""
    in_year = Window.partitionBy("year")
    return per_channel.select(
        "channel", "year", "total_orders", "units_sold",
        lakhs("revenue").alias("revenue_lakhs"),
        "avg_order_value", "avg_discount_pct",
        pct("profit", "revenue").alias("gross_margin_pct"),
        pct("revenue", F.sum("revenue").over(in_year)).alias("channel_share_pct"),
    ).orderBy("year", F.desc("revenue_lakhs"), "channel")


def quarterly_category(orders: DataFrame, pivot: bool = False) -> DataFrame:
    """Revenue, units, orders and mean discount per year, quarter and category.

    With ``pivot`` one row per year and category with the revenue of Q1..Q4 side by side.
    """
    sold = delivered(orders)
    if pivot:
        return (
            sold.groupBy("year", "category").pivot("quarter", list(QUARTERS))
            .agg(lakhs(F.sum("revenue_inr"))).orderBy("year", "category")
        )
    return (
        sold.groupBy("year", "quarter", "category")
        .agg(
            lakhs(F.sum("revenue_inr")).alias("revenue_lakhs"),
            F.sum("quantity").alias("units_sold"),
            F.countDistinct("order_id").alias("orders"),
            rnd(F.avg("discount_pct"), 1).alias("avg_discount_pct"),
        )
        .orderBy("year", "quarter", F.desc("revenue_lakhs"), "category")
    )


def yoy_category_growth(orders: DataFrame, years: tuple[int, int] = (2023, 2024)) -> DataFrame:
    """Revenue and units of two years side by side, for categories sold in both; lines without one are left out.

    One pass with conditional sums in place of a self-join. Growth uses the rounded revenues.
    """
    old, new = years

    def of(year: int, col: str):
        return F.sum(F.when(F.col("year") == year, F.col(col)))

    return (
        delivered(orders).filter(F.col("year").isin(old, new)).groupBy("category")
        .agg(
            lakhs(of(old, "revenue_inr")).alias(f"rev_{old}"),
            lakhs(of(new, "revenue_inr")).alias(f"rev_{new}"),
            of(old, "quantity").alias(f"units_{old}"),
            of(new, "quantity").alias(f"units_{new}"),
            count_where(F.col("year") == old).alias("lines_old"),
            count_where(F.col("year") == new).alias("lines_new"),
        )
        .filter(F.col("category").isNotNull() & (F.col("lines_old") > 0) & (F.col("lines_new") > 0))
        .select(
            "category", f"rev_{old}", f"rev_{new}",
            growth_pct(f"rev_{new}", f"rev_{old}").alias("yoy_growth_pct"),
            f"units_{old}", f"units_{new}",
        )
        .orderBy(F.desc("yoy_growth_pct"), "category")
    )


def rolling_ytd_revenue(orders: DataFrame, window: int = 3, corrected: bool = False) -> DataFrame:
    """Monthly revenue, its moving average over the last ``window`` rows, and the year to date.

    The average counts rows, not months: a month without sales widens its span. With ``corrected`` it is
    over the rows of the last ``window`` calendar months.
    """
    if corrected:
        trailing = Window.orderBy(F.col("year") * 12 + F.col("month")).rangeBetween(1 - window, 0)
    else:
        trailing = Window.orderBy("year", "month").rowsBetween(1 - window, 0)
    to_date = Window.partitionBy("year").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return (
        delivered(orders).groupBy(*MONTH).agg(lakhs(F.sum("revenue_inr")).alias("revenue_lakhs"))
        .withColumn(f"rolling_{window}m_avg_lakhs", rnd(F.avg("revenue_lakhs").over(trailing), 2))
        .withColumn("ytd_revenue_lakhs", rnd(F.sum("revenue_lakhs").over(to_date), 2))
        .orderBy("year", "month")
        .drop("month")
    )


def festive_performance(orders: DataFrame, months: Sequence[int] = FESTIVE_MONTHS) -> DataFrame:
    """Orders, units, revenue, discount and margin of the festive months per year, category, channel."""
    return (
        delivered(orders).filter(F.col("month").isin(*months)).groupBy("year", "category", "channel")
        .agg(
            F.countDistinct("order_id").alias("festive_orders"),
            F.sum("quantity").alias("festive_units"),
            lakhs(F.sum("revenue_inr")).alias("festive_revenue_lakhs"),
            rnd(F.avg("discount_pct"), 1).alias("avg_discount_pct"),
            rnd(F.avg("gross_margin_pct"), 1).alias("avg_margin_pct"),
        )
        .orderBy("year", F.desc("festive_revenue_lakhs"), "category", "channel")
    )


def kpi_by_year(
    orders: DataFrame, years: Sequence[int] = (2022, 2023, 2024), corrected: bool = False, growth: bool = True,
) -> DataFrame:
    """The KPI table of the selected years; the return rate counts lines of every status.

    Growth compares with the calendar year before, selected or not; without sales in that year it is 0.
    A selected year without lines keeps its row. One pass over the lines: each year's row is handed on
    to the next year as "previous". Of a year that is not selected only the revenue is summed, and without
    ``growth`` no such year is read (the column is left out). ``corrected``: see ``order_value``.
    """
    delivered_line = F.col("order_status") == DELIVERED
    selected = F.col("year").isin(*years)
    sold = delivered_line & selected if growth else delivered_line

    def if_sold(col: str):
        return F.when(sold, F.col(col))

    metrics = {
        "revenue": F.sum(F.when(delivered_line, F.col("revenue_inr"))),
        "sold_lines": count_where(delivered_line),
        "total_orders": F.countDistinct(if_sold("order_id")),
        "avg_order_value": rnd(F.avg(if_sold("selling_price")), 0),
        "units_sold": F.sum(if_sold("quantity")),
        "gross_margin_pct": rnd(F.avg(if_sold("gross_margin_pct")), 1),
        "avg_discount_pct": rnd(F.avg(if_sold("discount_pct")), 1),
        "return_rate_pct": rnd(F.avg(F.col("is_returned").cast("int")) * 100.0, 1),
        "unique_buyers": F.countDistinct(if_sold("customer_id")),
    }
    wanted = sorted({y + d for y in years for d in ((-1, 0) if growth else (0,))})
    yearly = orders.filter(F.col("year").isin(*wanted)).groupBy("year").agg(*[c.alias(n) for n, c in metrics.items()])
    own = F.col("shift") == 0
    shifted = (
        yearly.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("year", F.col("year") + F.col("shift"))
        .groupBy("year")
        .agg(
            *[F.max(F.when(own, F.col(n))).alias(n) for n in metrics],
            F.max(F.when(~own & (F.col("sold_lines") > 0), F.col("revenue"))).alias("prev_revenue"),
        )
    )
    skeleton = domain_frame(orders.sparkSession, "year", list(years)).select(F.col("year").cast("long"))
    counts = ["total_orders", "units_sold", "unique_buyers"]
    table = (
        skeleton.join(shifted, "year", "left")
        .fillna(0, ["revenue", *counts])
        .withColumn("prev_revenue", F.coalesce("prev_revenue", "revenue"))
        .select(
            "year",
            lakhs("revenue", 1).alias("revenue_lakhs"),
            growth_pct("revenue", "prev_revenue").alias("yoy_growth_pct"),
            "total_orders",
            rnd(ratio("revenue", "total_orders"), 0).alias("avg_order_value") if corrected else "avg_order_value",
            "units_sold", "gross_margin_pct", "avg_discount_pct", "return_rate_pct", "unique_buyers",
        )
        .orderBy("year")
    )
    return table if growth else table.drop("yoy_growth_pct")


def monthly_trend(orders: DataFrame) -> DataFrame:
    """Revenue in lakhs per month, unrounded; lines without a month are left out."""
    return (
        delivered(orders).dropna(subset=list(MONTH)).groupBy(*MONTH)
        .agg((F.sum("revenue_inr") / 1e5).alias("revenue_lakhs")).orderBy("year", "month")
    )


def peak_month_by_year(monthly: DataFrame) -> DataFrame:
    """The month with the highest revenue of each year, the earlier one on a tie."""
    best = F.min(F.struct((-F.col("revenue_lakhs")).alias("neg"), "month", "month_name"))
    return (
        monthly.filter(F.col("revenue_lakhs").isNotNull()).groupBy("year").agg(best.alias("best"))
        .select("year", "best.month", "best.month_name", (-F.col("best.neg")).alias("revenue_lakhs"))
        .orderBy("year")
    )


def calendar_bands(
    monthly: DataFrame, festive: Sequence[int] = FESTIVE_MONTHS, sale: Sequence[int] = SALE_MONTHS,
) -> DataFrame:
    """Months tagged with the season they fall in, NULL outside both."""
    month = F.col("month")
    return monthly.withColumn(
        "season", F.when(month.isin(*festive), "Festive").when(month.isin(*sale), "Valentine / Sale")
    )


def category_revenue_margin(orders: DataFrame, target: float = 50) -> DataFrame:
    """Revenue and the plain mean of line margins per category, with a flag for reaching ``target`` %.

    Lines without a category are left out.
    """
    return (
        delivered(orders).dropna(subset=["category"]).groupBy("category")
        .agg((F.sum("revenue_inr") / 1e5).alias("revenue_lakhs"), F.avg("gross_margin_pct").alias("avg_margin_pct"))
        .withColumn("meets_target", F.col("avg_margin_pct") >= float(target))
        .orderBy(F.desc("revenue_lakhs"), "category")
    )


def channel_mix_pivot(orders: DataFrame, channels: Sequence[str] | None = None) -> DataFrame:
    """Year by channel: revenue in lakhs (column = channel) and share of the year (``<channel>_share_pct``).

    ``channels`` fixes the columns and their order; revenue of any other channel is in ``Other``. Without it the
    channels that are present are the columns, found by a job of its own. A channel without sales is 0. Lines
    without a channel are left out, of the shares too.
    """
    sold = delivered(orders).filter(F.col("channel").isNotNull())
    channels, named = columns_for(sold, "channel", channels)
    yearly = sold.groupBy("year", named.alias("channel")).agg((F.sum("revenue_inr") / 1e5).alias("lakhs"))
    pivoted = yearly.groupBy("year").agg(
        F.sum("lakhs").alias("total"),
        *[F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("lakhs"))), F.lit(0.0)).alias(c) for c in channels],
    )
    return pivoted.select(
        "year",
        *[F.col(f"`{c}`") for c in channels],
        *[(ratio(F.col(f"`{c}`"), "total") * 100.0).alias(f"{c}_share_pct") for c in channels],
    ).orderBy("year")


def hero_skus(orders: DataFrame, products: DataFrame, k: int = 15, name_len: int = 35) -> DataFrame:
    """The ``k`` products with the highest revenue; category as recorded on the order lines.

    Lines are reduced to product and category before the catalogue join. Products without a name and lines
    without a category are left out.
    """
    sums = {
        "revenue": F.sum("revenue_inr"),
        "units": F.sum("quantity"),
        "margin_sum": F.sum("gross_margin_pct"),
        "margin_n": F.count("gross_margin_pct"),
    }
    sold = delivered(orders).groupBy("product_id", "category").agg(*[c.alias(n) for n, c in sums.items()])
    return (
        sold.join(products.select("product_id", "product_name"), "product_id")
        .groupBy("product_id", "product_name", "category").agg(*[F.sum(n).alias(n) for n in sums])
        .dropna(subset=["product_name", "category"])
        .orderBy(F.desc("revenue"), "product_id", "product_name", "category")
        .limit(k)
        .select(
            "product_id", "product_name",
            F.substring("product_name", 1, name_len).alias("label"),
            "category",
            (F.col("revenue") / RUPEES_PER_THOUSAND).alias("revenue_thousands"),
            "units",
            ratio("margin_sum", "margin_n").alias("avg_margin_pct"),
        )
    )


def yoy_growth_pivot(orders: DataFrame, years: tuple[int, int] = (2023, 2024)) -> DataFrame:
    """Category revenue (lakhs) of two years and its growth, unrounded.

    A missing year counts as 0: a category gone in the second year shows -100, one new in it has
    no base and is left out, and so are lines without a category.
    """
    old, new = (str(y) for y in years)
    return (
        delivered(orders).filter(F.col("year").isin(*years) & F.col("category").isNotNull())
        .groupBy("category").pivot("year", list(years))
        .agg(F.sum("revenue_inr") / 1e5).fillna(0.0)
        .withColumn("growth_pct", ratio(F.col(new) - F.col(old), old) * 100.0)
        .dropna(subset=["growth_pct"])
        .select("category", F.col(old).alias(f"rev_{old}"), F.col(new).alias(f"rev_{new}"), "growth_pct")
        .orderBy("growth_pct", "category")
    )


def yoy_extremes(growth: DataFrame) -> DataFrame:
    """Fastest growing and most declining category of ``yoy_growth_pivot``."""
    return growth.agg(
        first_largest("growth_pct", "category").alias("fastest_growing"),
        first_smallest("growth_pct", "category").alias("most_declining"),
    )
