"""Fixed values of the retail model, and expressions over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# They must equal the values in the data for right results.
DELIVERED = "Delivered"
CANCELLED = "Cancelled"
SIZES = ("XS", "S", "M", "L", "XL", "XXL")
CORE_SIZES = ("M", "L")
QUARTERS = ("Q1", "Q2", "Q3", "Q4")
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
FESTIVE_MONTHS = (10, 11, 12)
SALE_MONTHS = (2,)
SEGMENTS = ("Champion", "Loyal", "Potential Loyalist", "Recent", "At Risk", "Lost")
CHANNELS = ("D2C Website", "Amazon", "Flipkart", "Myntra", "Nykaa Fashion", "Offline (Studio Store)")
HEATMAP_TYPES = (
    "Classic T-Shirt", "Oversized T-Shirt", "Hoodie", "Sweatshirt", "Joggers", "Shorts", "Crop Top", "Tote Bag",
)
OVERSTOCKED, LOW_STOCK, STOCKOUT = "Overstocked", "Low Stock", "Stockout"
URGENCY = (STOCKOUT, LOW_STOCK, OVERSTOCKED, "Normal", "Healthy")


def position_in(values: Sequence[str], col: Column | str) -> Column:
    """1-based position in a fixed list, 0 for a value outside it."""
    col = F.col(col) if isinstance(col, str) else col
    return F.array_position(F.array(*[F.lit(v) for v in values]), col)


def most_urgent(status: str) -> Column:
    """Aggregate: the first of ``URGENCY`` among the statuses of a group. Keeps one number per group."""
    return _label(URGENCY, F.min(F.nullif(position_in(URGENCY, status), F.lit(0).cast("long"))))


def _label(names: Sequence[str], number: Column | str) -> Column:
    """The name at a 1-based number: a lookup in a literal, with no string built per row."""
    number = F.col(number) if isinstance(number, str) else number
    return F.element_at(F.array(*[F.lit(n) for n in names]), number.cast("int"))


def month_label(month: Column | str) -> Column:
    return _label(MONTH_NAMES, month)


def quarter_label(quarter: Column | str) -> Column:
    return _label(QUARTERS, quarter)


OTHER = "Other"


def columns_for(df: DataFrame, name: str, values: Sequence[str] | None) -> tuple[list[str], Column]:
    """The columns of a pivot on ``name`` and the column each row belongs to.

    A given list gets ``Other`` for every value outside it. Without a list they are the values present, sorted; these
    come to the driver, and more than ``spark.sql.pivotMaxValues`` of them are an error, as in Spark's own pivot.
    """
    if values is not None:
        inside = F.col(name).isin(*values)
        return [*values, OTHER], F.when(F.col(name).isNotNull(), F.when(inside, F.col(name)).otherwise(OTHER))
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    present = [row[0] for row in df.select(name).dropna().distinct().orderBy(name).take(most + 1)]
    if len(present) > most:
        raise ValueError(f"over {most} values of {name}: name those that are to be columns")
    return present, F.col(name)


def domain_frame(spark: SparkSession, name: str, values: Sequence) -> DataFrame:
    """A fixed list as a DataFrame (``position``, ``name``): the row skeleton of a reindexed report."""
    items = F.array(*[F.lit(v) for v in values])
    return spark.range(0, 1, 1, 1).select(F.posexplode(items).alias("position", name))
