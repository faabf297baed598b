"""Return rates. Lines of every status count here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.domains import columns_for
from ..functions.numeric import count_where, lakhs, pct, rnd


def return_rate_category_channel(orders: DataFrame) -> DataFrame:
    """Distinct orders, returned lines, their ratio (it may exceed 100 %), returned revenue and price."""
    returned = F.col("is_returned")
    return (
        orders.groupBy("category", "channel")
        .agg(
            F.countDistinct("order_id").alias("total_orders"),
            count_where(returned).alias("returned_orders"),
            lakhs(F.sum(F.when(returned, F.col("revenue_inr")).otherwise(0.0))).alias("returned_revenue_lakhs"),
            rnd(F.avg(F.when(returned, F.col("selling_price"))), 0).alias("avg_returned_order_value"),
        )
        .select(
            "category", "channel", "total_orders", "returned_orders",
            pct("returned_orders", "total_orders").alias("return_rate_pct"),
            "returned_revenue_lakhs", "avg_returned_order_value",
        )
        .orderBy(F.desc("return_rate_pct"), "category", "channel")
    )


def return_rate_matrix(orders: DataFrame, channels: Sequence[str] | None = None) -> DataFrame:
    """Returned lines in % of lines, category by channel.

    ``channels`` fixes the columns and their order; lines of any other channel are in ``Other``. Without it the
    channels that are present are the columns, found by a job of its own. Lines without a category or channel
    are left out.
    """
    known = orders.dropna(subset=["category", "channel"])
    channels, named = columns_for(known, "channel", channels)
    return (
        known.withColumn("channel", named).groupBy("category").pivot("channel", channels)
        .agg(rnd(F.avg(F.col("is_returned").cast("int")) * 100.0, 1)).orderBy("category")
    )


def overall_return_rate(orders: DataFrame) -> DataFrame:
    """Returned lines in % of all lines."""
    return orders.agg(rnd(F.avg(F.col("is_returned").cast("int")) * 100.0, 1).alias("return_rate_pct"))
