"""Derived columns of the model: line money, calendar, list margin, marketing efficiency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .domains import month_label, quarter_label
from .numeric import ratio


def line_revenue(lines: DataFrame) -> DataFrame:
    """Add selling price and revenue to order lines, from ``mrp``, ``discount_pct`` and ``quantity``."""
    return lines.withColumn("selling_price", F.col("mrp") * (1.0 - F.col("discount_pct") / 100.0)).withColumn(
        "revenue_inr", F.col("selling_price") * F.col("quantity")
    )


def line_measures(lines: DataFrame) -> DataFrame:
    """Add selling price, revenue, gross profit and margin % to order lines.

    Needs ``mrp``, ``discount_pct``, ``quantity`` and the unit ``cost_price``.
    """
    return (
        line_revenue(lines)
        .withColumn("gross_profit_inr", F.col("revenue_inr") - F.col("cost_price") * F.col("quantity"))
        .withColumn("gross_margin_pct", ratio("gross_profit_inr", "revenue_inr") * 100.0)
    )


def time_dims(df: DataFrame, date_col: str) -> DataFrame:
    """Add ``year``, ``month``, ``month_name`` (Jan..Dec) and calendar ``quarter`` (Q1..Q4)."""
    d = F.col(date_col)
    return df.withColumns(
        {
            "year": F.year(d).cast("long"),
            "month": F.month(d).cast("long"),
            "month_name": month_label(F.month(d)),
            "quarter": quarter_label(F.quarter(d)),
        }
    )


def product_margin(products: DataFrame) -> DataFrame:
    """Add the list margin, (MRP - cost) / MRP in %."""
    return products.withColumn("gross_margin_pct", ratio(F.col("mrp") - F.col("cost_price"), "mrp") * 100.0)


def marketing_efficiency(marketing: DataFrame) -> DataFrame:
    """Add ROAS, cost per click and cost per acquisition, from raw spend (lakhs), clicks and conversions."""
    spend_inr = F.col("spend_inr_lakhs") * 1e5
    return marketing.withColumns(
        {
            "roas": ratio("attributed_revenue_lakhs", "spend_inr_lakhs"),
            "cpc_inr": ratio(spend_inr, "clicks"),
            "cac_inr": ratio(spend_inr, "conversions"),
        }
    )
