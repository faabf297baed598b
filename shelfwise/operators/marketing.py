"""Return on marketing spend. ROAS is a ratio of sums; the stored CAC is averaged as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import first_largest, ratio, rnd


def marketing_roas_quarterly(marketing: DataFrame) -> DataFrame:
    """Spend, attributed revenue, ROAS, mean CAC and conversions per year, quarter and channel."""
    spend, revenue = F.sum("spend_inr_lakhs"), F.sum("attributed_revenue_lakhs")
    return (
        marketing.groupBy("year", "quarter", "marketing_channel")
        .agg(
            rnd(spend, 2).alias("total_spend_lakhs"),
            rnd(revenue, 2).alias("attributed_revenue_lakhs"),
            rnd(ratio(revenue, spend), 2).alias("blended_roas"),
            rnd(F.avg("cac_inr"), 0).alias("avg_cac_inr"),
            F.sum("conversions").alias("total_conversions"),
        )
        .orderBy("year", "quarter", F.desc("blended_roas"), "marketing_channel")
    )


def marketing_roi_year(
    marketing: DataFrame, year: int = 2024, tiers: tuple[float, float] = (3, 4.5),
) -> DataFrame:
    """One year per channel: spend, revenue, mean CAC, ROAS with its tier, and the rank by spend.

    ``below_floor`` marks a ROAS under the first tier limit. Spend without a channel is left out.
    """
    floor, good = tiers
    roas = F.col("roas")
    by_spend = Window.orderBy(F.desc("spend_lakhs"), "marketing_channel")
    return (
        marketing.filter((F.col("year") == year) & F.col("marketing_channel").isNotNull()).groupBy("marketing_channel")
        .agg(
            F.sum("spend_inr_lakhs").alias("spend_lakhs"),
            F.sum("attributed_revenue_lakhs").alias("revenue_lakhs"),
            F.avg("cac_inr").alias("avg_cac_inr"),
        )
        .withColumn("roas", rnd(ratio("revenue_lakhs", "spend_lakhs"), 2))
        .withColumn(
            "tier", F.when(roas < floor, f"<{floor:g}").when(roas < good, f"{floor:g}–{good:g}")
            .when(roas >= good, f"≥{good:g}")
        )
        .withColumn("below_floor", roas < floor)
        .withColumn("spend_rank", F.row_number().over(by_spend).cast("long"))
        .orderBy("roas", "marketing_channel")
    )


def best_roas_channel(roi: DataFrame) -> DataFrame:
    """The channel with the highest ROAS of ``marketing_roi_year``."""
    return roi.agg(
        first_largest("roas", "marketing_channel").alias("best_channel"), F.max("roas").alias("best_roas")
    )
