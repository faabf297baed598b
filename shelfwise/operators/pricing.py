"""Discount bands, elasticity, licensed margin, discount against margin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import case, lakhs, ratio, rnd
from ..sources.loader import delivered

# Labels and closed ranges of the discount bands. Anything else is the last band.
LITERAL_BANDS = (("0% (No Discount)", 0, 0), ("1–10%", 1, 10), ("11–20%", 11, 20), ("21–30%", 21, 30))
REST_BAND = "30%+"


def discount_band(discount: Column, bands: Sequence[tuple[str, float, float]], contiguous: bool) -> Column:
    """The band's label. ``contiguous`` starts each band right above the one before, closing the gaps."""
    rules, below = [], None
    for label, low, high in bands:
        gapless = contiguous and below is not None
        inside = (discount > below) & (discount <= high) if gapless else discount.between(low, high)
        rules.append((inside, label))
        below = high
    return case(*rules, default=REST_BAND)


def discount_bands(
    orders: DataFrame, bands: Sequence[tuple[str, float, float]] = LITERAL_BANDS, contiguous: bool = False,
) -> DataFrame:
    """Orders, units, revenue, mean margin and profit per discount band, lowest discount first.

    The literal bands leave gaps (0.5 %, 10.5 %, ...) that fall into the last one.
    """
    return (
        delivered(orders)
        .withColumn("discount_band", discount_band(F.col("discount_pct"), bands, contiguous))
        .groupBy("discount_band")
        .agg(
            F.countDistinct("order_id").alias("orders"),
            F.sum("quantity").alias("units_sold"),
            lakhs(F.sum("revenue_inr")).alias("revenue_lakhs"),
            rnd(F.avg("gross_margin_pct"), 1).alias("avg_gross_margin_pct"),
            lakhs(F.sum("gross_profit_inr")).alias("gross_profit_lakhs"),
            F.min("discount_pct").alias("lowest"),
        )
        .orderBy("lowest")
        .drop("lowest")
    )


def price_elasticity_proxy(orders: DataFrame) -> DataFrame:
    """Per category: mean discount and price, units, revenue, and the discount-quantity correlation.

    The correlation is Pearson's over all lines, a missing value counting as 0. It is taken from central
    moments: raw sums of squares would lose their digits over billions of lines. NULL where discount
    or quantity do not vary (``corr`` would raise there).
    """
    discount, quantity = (F.coalesce(c, F.lit(0.0)) for c in ("discount_pct", "quantity"))
    spread = F.stddev_pop(discount) * F.stddev_pop(quantity)
    return (
        delivered(orders).groupBy("category")
        .agg(
            rnd(F.avg("discount_pct"), 1).alias("avg_discount_pct"),
            rnd(F.avg("selling_price"), 0).alias("avg_selling_price"),
            F.sum("quantity").alias("units_sold"),
            lakhs(F.sum("revenue_inr")).alias("revenue_lakhs"),
            rnd(ratio(F.covar_pop(discount, quantity), spread), 3).alias("discount_qty_correlation"),
        )
        .orderBy(F.desc("discount_qty_correlation"), "category")
    )


def licensed_margin(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Licensed against own designs: orders, units, list price and margin, discount, realised margin.

    ``avg_mrp`` and ``avg_product_margin_pct`` are means over order lines, not over products.
    """
    catalogue = products.select(
        "product_id", "is_licensed", F.col("mrp").alias("list_mrp"), F.col("gross_margin_pct").alias("list_margin")
    )
    return (
        delivered(orders).join(catalogue, "product_id").groupBy("is_licensed")
        .agg(
            F.countDistinct("order_id").alias("orders"),
            F.sum("quantity").alias("units_sold"),
            rnd(F.avg("list_mrp"), 0).alias("avg_mrp"),
            rnd(F.avg("list_margin"), 1).alias("avg_product_margin_pct"),
            rnd(F.avg("discount_pct"), 1).alias("avg_discount_pct"),
            rnd(F.avg("gross_margin_pct"), 1).alias("avg_realised_margin_pct"),
            lakhs(F.sum("revenue_inr")).alias("revenue_lakhs"),
            lakhs(F.sum("gross_profit_inr")).alias("gross_profit_lakhs"),
        )
    )


def discount_margin_quadrants(
    orders: DataFrame, disc_cut: float = 15, gm_cut: float = 50, scale: float = 600,
) -> DataFrame:
    """Mean discount and margin and revenue per category and channel, with bubble size and quadrant.

    Lines without a category or channel are left out.
    """
    everything = Window.partitionBy()
    high_discount, high_margin = F.col("avg_discount_pct") > disc_cut, F.col("avg_margin_pct") >= gm_cut
    quadrant = case(
        (~high_discount & high_margin, "Low Disc, High Margin"),
        (high_discount & high_margin, "High Disc, High Margin"),
        (high_discount & ~high_margin, "Danger: High Disc, Low Margin"),
        (~high_discount & ~high_margin, "Low Disc, Low Margin"),
    )
    return (
        delivered(orders).dropna(subset=["category", "channel"]).groupBy("category", "channel")
        .agg(
            F.avg("discount_pct").alias("avg_discount_pct"),
            F.avg("gross_margin_pct").alias("avg_margin_pct"),
            (F.sum("revenue_inr") / 1e5).alias("revenue_lakhs"),
        )
        .withColumn(
            "bubble_size", ratio("revenue_lakhs", F.max("revenue_lakhs").over(everything)) * float(scale)
        )
        .withColumn("quadrant", quadrant)
        .orderBy("category", "channel")
    )
