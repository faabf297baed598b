"""Seasonality indices. The mean over months is a window over at most twelve rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domains import month_label
from ..functions.numeric import lakhs, ratio, rnd
from ..sources.loader import delivered


def _month_mean(value: str) -> Column:
    return F.avg(value).over(Window.partitionBy())


def seasonality_index_avg(orders: DataFrame, peak: float = 1.2, trough: float = 0.85) -> DataFrame:
    """Mean line revenue per calendar month (rounded, in lakhs) against the mean of the months.

    The label is decided on the unrounded ratio.
    """
    index = ratio("avg_monthly_rev_lakhs", "annual_monthly_avg")
    return (
        delivered(orders).groupBy("month", "month_name")
        .agg(lakhs(F.avg("revenue_inr")).alias("avg_monthly_rev_lakhs"))
        .withColumn("annual_monthly_avg", _month_mean("avg_monthly_rev_lakhs"))
        .withColumn("seasonality_index", rnd(index, 3))
        .withColumn("demand_label", F.when(index > peak, "Peak").when(index < trough, "Trough").otherwise("Normal"))
        .orderBy("month")
    )


def seasonality_index_sum(orders: DataFrame, peak: float = 1.10, trough: float = 0.88) -> DataFrame:
    """Total revenue per calendar month over all years against the mean of the months.

    The label is decided on the rounded index. Lines without a month are left out.
    """
    index = F.col("seasonality_index")
    return (
        delivered(orders).dropna(subset=["month"]).groupBy("month").agg((F.sum("revenue_inr") / 1e5).alias("revenue_lakhs"))
        .withColumn("month_name", month_label("month"))
        .withColumn("seasonality_index", rnd(ratio("revenue_lakhs", _month_mean("revenue_lakhs")), 3))
        .withColumn("demand_label", F.when(index > peak, "Peak").when(index > trough, "Normal").otherwise("Trough"))
        .orderBy("month")
    )


def peak_months(index: DataFrame, peak: float = 1.10) -> DataFrame:
    """One row: the names of the peak months of ``seasonality_index_sum``, in calendar order (at most 12)."""
    high = F.when(F.col("seasonality_index") > peak, F.struct("month", "month_name"))
    return index.agg(F.array_sort(F.collect_list(high)).alias("m")).select(
        F.col("m.month_name").alias("peak_months")
    )
