"""Stock health, overstock and reorder lists, size curves, sell-through.

Stock tables have one row per product and size, so the catalogue joins carry at most one row per
size and product. Spark broadcasts the catalogue when it is small enough and shuffles otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domains import (
    CORE_SIZES, HEATMAP_TYPES, LOW_STOCK, OVERSTOCKED, SIZES, STOCKOUT, domain_frame, position_in,
)
from ..functions.numeric import count_where, lakhs, ratio, rnd


# Labels of the lists.
PRIORITIES = ("P1 - Urgent", "P2 - High", "P3 - Medium")
CLEARANCE = "Clearance Recommended"


def inventory_health_by_category(inventory: DataFrame, corrected: bool = False) -> DataFrame:
    """SKUs, stock, mean sell-through, velocity and cover per category.

    The ``*_skus`` counts are of SKU-sizes, with ``corrected`` of SKUs that have such a size. Stock is first
    summed per SKU: the one shuffle of its rows then serves every count of SKUs.
    """
    means = {"sell_through_pct": ("avg_sell_through_pct", 1), "rate_of_sale_per_week": ("avg_ros_per_week", 2),
             "weeks_of_cover": ("avg_weeks_of_cover", 1)}
    counts = {"stockout_skus": STOCKOUT, "low_stock_skus": LOW_STOCK, "overstock_skus": OVERSTOCKED}
    per_sku = inventory.groupBy("category", "product_id").agg(
        F.sum("closing_stock").alias("closing"),
        F.sum("stock_value_at_cost").alias("cost"),
        *[agg(c).alias(f"{c}_{kind}") for c in means for kind, agg in (("sum", F.sum), ("n", F.count))],
        *[count_where(F.col("stock_health_status") == status).alias(name) for name, status in counts.items()],
    )
    return (
        per_sku.groupBy("category")
        .agg(
            F.count("product_id").alias("sku_count"),
            F.sum("closing").alias("total_closing_units"),
            *[rnd(ratio(F.sum(f"{c}_sum"), F.sum(f"{c}_n")), n).alias(name) for c, (name, n) in means.items()],
            *[(count_where((F.col(name) > 0) & F.col("product_id").isNotNull()) if corrected else F.sum(name)).alias(name) for name in counts],
            lakhs(F.sum("cost")).alias("stock_value_at_cost_lakhs"),
        )
        .orderBy(F.desc("avg_sell_through_pct"), "category")
    )


def overstock_alert(
    inventory: DataFrame, products: DataFrame, min_woc: float = 16, max_st: float = 30, min_closing: int = 20,
    markdown: float = 0.35, k: int | None = 30,
) -> DataFrame:
    """The ``k`` dead-stock SKU-sizes with the most money in them, and the loss of a markdown.

    ``k=None`` lists all of them.
    """
    dead = inventory.filter(
        (F.col("weeks_of_cover") > min_woc) & (F.col("sell_through_pct") < max_st)
        & (F.col("closing_stock") > min_closing)
    ).drop("category", "product_type")
    ranked = (
        dead.join(products.select("product_id", "product_name", "category", "product_type"), "product_id")
        .orderBy(F.desc("stock_value_at_cost"), "product_id", "size")
    )
    return (ranked if k is None else ranked.limit(k)).select(
        "product_id", "product_name", "category", "product_type", "size", "closing_stock", "sell_through_pct",
        "rate_of_sale_per_week", "weeks_of_cover", "stock_value_at_mrp", "stock_value_at_cost",
        rnd(F.col("stock_value_at_cost") * markdown, 0).alias("potential_markdown_loss"),
        F.lit(CLEARANCE).alias("action_flag"),
    )


def reorder_priority(
    inventory: DataFrame, products: DataFrame, cover_weeks: float = 8, high_woc: float = 4,
) -> DataFrame:
    """What to reorder, how much for ``cover_weeks`` weeks, and how urgently."""
    urgency = (
        F.when(F.col("closing_stock") == 0, 0).when(F.col("weeks_of_cover") < high_woc, 1).otherwise(2)
    )
    labels = F.array(*[F.lit(p) for p in PRIORITIES])
    wanted = F.col("rate_of_sale_per_week") * float(cover_weeks)
    return (
        inventory.filter("reorder_recommended").drop("category")
        .join(products.select("product_id", "product_name", "category", "cost_price"), "product_id")
        .withColumn("urgency", urgency)
        .orderBy("urgency", F.desc("rate_of_sale_per_week"), "product_id", "size")
        .select(
            "product_id", "product_name", "category", "size", "closing_stock", "rate_of_sale_per_week",
            "weeks_of_cover", "stock_health_status",
            rnd(wanted, 0).alias("suggested_reorder_qty"),
            "cost_price",
            rnd(wanted * F.col("cost_price"), 0).alias("reorder_value_inr"),
            labels[F.col("urgency")].alias("reorder_priority"),
        )
    )


def size_curve_by_category(inventory: DataFrame, products: DataFrame, sizes: Sequence[str] = SIZES) -> DataFrame:
    """Units sold, stock left, sell-through and unrounded share of units per catalogue category and size."""
    in_category = Window.partitionBy("category")
    return (
        inventory.drop("category").join(products.select("product_id", "category"), "product_id")
        .groupBy("category", "size")
        .agg(
            F.sum("units_sold").alias("units_sold"),
            F.sum("closing_stock").alias("units_remaining"),
            rnd(F.avg("sell_through_pct"), 1).alias("avg_sell_through_pct"),
        )
        .withColumn(
            "size_contribution_pct", ratio("units_sold", F.sum("units_sold").over(in_category)) * 100.0
        )
        .orderBy("category", position_in(sizes, "size"), "size")
    )


def sell_through_by_type_gender(inventory: DataFrame, products: DataFrame) -> DataFrame:
    """SKUs, mean sell-through, velocity, cover and units per catalogue type and gender."""
    return (
        inventory.drop("product_type").join(products.select("product_id", "product_type", "gender"), "product_id")
        .groupBy("product_type", "gender")
        .agg(
            F.countDistinct("product_id").alias("sku_count"),
            rnd(F.avg("sell_through_pct"), 1).alias("avg_sell_through_pct"),
            rnd(F.avg("rate_of_sale_per_week"), 2).alias("avg_ros"),
            rnd(F.avg("weeks_of_cover"), 1).alias("avg_weeks_cover"),
            F.sum("units_sold").alias("total_units_sold"),
        )
        .orderBy(F.desc("avg_sell_through_pct"), "product_type", "gender")
    )


def sell_through_matrix(inventory: DataFrame, types: Sequence[str] = HEATMAP_TYPES) -> DataFrame:
    """Mean sell-through, category by product type. ``types`` selects and orders the columns.

    Stock without a category is left out.
    """
    return (
        inventory.dropna(subset=["category"]).groupBy("category").pivot("product_type", list(types))
        .agg(rnd(F.avg("sell_through_pct"), 1)).orderBy("category")
    )


def stock_health_distribution(inventory: DataFrame) -> DataFrame:
    """SKU-sizes per stock status and their share in %."""
    everything = Window.partitionBy()
    return (
        inventory.filter(F.col("stock_health_status").isNotNull())
        .groupBy("stock_health_status").agg(F.count(F.lit(1)).alias("sku_sizes"))
        .withColumn("share_pct", rnd(ratio("sku_sizes", F.sum("sku_sizes").over(everything)) * 100.0, 1))
        .orderBy(F.desc("sku_sizes"), "stock_health_status")
    )


def overstock_share(inventory: DataFrame) -> DataFrame:
    """SKU-sizes in all, overstocked ones, and their share in %."""
    return inventory.agg(
        F.count(F.lit(1)).alias("sku_sizes"),
        count_where(F.col("stock_health_status") == OVERSTOCKED).alias("overstocked"),
    ).withColumn("overstock_pct", rnd(ratio("overstocked", "sku_sizes") * 100.0, 1))


def size_curve(
    inventory: DataFrame, sizes: Sequence[str] = SIZES, core: Sequence[str] = CORE_SIZES,
) -> DataFrame:
    """Units sold and mean sell-through per size, in size order; a size without stock rows stays, as NULL."""
    per_size = inventory.groupBy("size").agg(
        F.sum("units_sold").alias("units_sold"), F.avg("sell_through_pct").alias("avg_sell_through_pct")
    )
    return (
        domain_frame(inventory.sparkSession, "size", sizes).join(per_size, "size", "left")
        .orderBy("position")
        .select("size", "units_sold", "avg_sell_through_pct", F.col("size").isin(*core).alias("is_core"))
    )
