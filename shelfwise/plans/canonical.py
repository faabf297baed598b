"""The retail model on top of a TPC-H-like star schema.

Every table is a lazy view built on first use. Joins carry no broadcast hints: Spark broadcasts a side
only when its size is below ``spark.sql.autoBroadcastJoinThreshold``, and otherwise shuffles both.
"""

from __future__ import annotations

import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.domains import CANCELLED, SIZES, position_in
from ..functions.measures import line_measures, line_revenue, marketing_efficiency, product_margin, time_dims
from ..functions.numeric import case
from ..operators.builders import inventory_snapshot, stock_grid
from ..sources.loader import Tables

# Parameters of the reports on these tables.
YEAR, YEARS2, YEARS3 = 2000, (1999, 2000), (1998, 1999, 2000)
AS_OF = datetime.date(2001, 8, 2)
STOCK_SINCE, STOCK_AS_OF, STOCK_WEEKS = datetime.date(1999, 8, 1), datetime.date(2001, 8, 1), 104
CHANNELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
TYPES = tuple(f"Brand#{i}" for i in range(1, 9))

_SCHEMAS: dict[tuple[str, str], StructType] = {}


def _span(years: tuple[int, ...]) -> tuple[datetime.date, datetime.date]:
    return datetime.date(min(years), 1, 1), datetime.date(max(years), 12, 31)


def _cost_share() -> Column:
    """Unit cost as a share of the price, by part size."""
    return 0.3 + 0.01 * (F.col("p_size") % 10)


class CanonicalModel:
    """Tables of the retail model, read from ``<folder>/<table>.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        """A driver table. Its schema is read from the files once per application, then reused."""
        path = f"{self.folder}/{name}.parquet"
        key = (self.spark.sparkContext.applicationId, path)
        if key not in _SCHEMAS:
            _SCHEMAS[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[key]).parquet(path)

    def _lines(
        self, placed: bool, costed: bool, part_first: bool = False, dates: tuple[datetime.date, datetime.date] | None = None
    ) -> DataFrame:
        """Order lines, ``placed`` with their order, ``costed`` with their part: only what a report reads is joined.

        Joins are outer, so a line whose order, part or supplier is missing still counts wherever that is not asked
        for; a filter on a column of the order makes its join an inner one. Orders come first, so that a filter on
        their status drops lines before these meet their part. With ``part_first`` orders come last, for reports on
        lines of every status: lines are then partitioned by order, and distinct orders are counted without another
        shuffle. ``dates`` limits the order dates (both included), for the scan to prune.
        """
        unit_price = F.col("l_extendedprice") / F.col("l_quantity")
        columns = {
            "order_id": F.col("l_orderkey"),
            "product_id": F.col("l_partkey"),
            "size": case(*[(F.col("l_linenumber") == i, s) for i, s in enumerate(SIZES, 1)], default="M"),
            "quantity": F.col("l_quantity").cast("long"),
            "mrp": unit_price,
            # Nearest whole percent; ``round`` on doubles goes through BigDecimal for every row.
            "discount_pct": F.floor(F.col("l_discount") * 400.0 + 0.5).cast("double"),
            "is_returned": F.col("l_returnflag") == "R",
        }
        lines = self.raw("lineitem")
        part = lambda lines: lines.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
        if costed:
            columns |= {"category": F.col("p_type"), "product_type": F.col("p_brand"), "cost_price": unit_price * _cost_share()}
        if costed and part_first:
            lines = part(lines)
        if placed:
            orders, day = self.raw("orders"), F.col("o_orderdate").cast("date")
            if dates:
                orders = orders.filter((day >= F.lit(dates[0])) & (day <= F.lit(dates[1])))
            lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner" if dates else "left")
            # Nested two-way cases on null-safe tests: a filter on one status folds to one comparison
            # and is pushed into the orders scan.
            status = case(
                (F.col("o_orderstatus").eqNullSafe("F"), "Delivered"),
                default=case((F.col("o_orderstatus").eqNullSafe("P"), "Returned"), default=CANCELLED),
            )
            columns |= {
                "order_date": day, "customer_id": F.col("o_custkey"), "channel": F.col("o_orderpriority"), "order_status": status,
            }
        if costed and not part_first:
            lines = part(lines)
        lines = lines.select(*[c.alias(n) for n, c in columns.items()])
        lines = line_measures(lines).drop("cost_price") if costed else line_revenue(lines)
        return time_dims(lines, "order_date") if placed else lines

    @cached_property
    def lines(self) -> DataFrame:
        """Order lines alone: product, size, quantity, money, returned or not."""
        return self._lines(placed=False, costed=False)

    @cached_property
    def costed(self) -> DataFrame:
        """Lines with category, type, profit and margin of their part."""
        return self._lines(placed=False, costed=True)

    @cached_property
    def placed(self) -> DataFrame:
        """Lines with date, customer, channel and status of their order."""
        return self._lines(placed=True, costed=False)

    @cached_property
    def orders(self) -> DataFrame:
        """Lines with both: the model's table of order lines."""
        return self._lines(placed=True, costed=True)

    @cached_property
    def orders_of_every_status(self) -> DataFrame:
        """The same rows, joined for reports that have no use for the status."""
        return self._lines(placed=True, costed=True, part_first=True)

    def orders_of(self, *years: int) -> DataFrame:
        """``orders`` from the first to the last of the years, as a date range that reaches the scan."""
        return self._lines(placed=True, costed=True, dates=_span(years))

    @cached_property
    def products(self) -> DataFrame:
        return product_margin(
            self.raw("part").select(
                F.col("p_partkey").alias("product_id"),
                F.col("p_name").alias("product_name"),
                F.col("p_type").alias("category"),
                F.col("p_brand").alias("product_type"),
                F.when(F.col("p_size") % 2 == 0, "Men").otherwise("Women").alias("gender"),
                F.col("p_retailprice").alias("mrp"),
                (F.col("p_retailprice") * _cost_share()).alias("cost_price"),
                (F.col("p_partkey") % 5 != 0).alias("is_licensed"),
            )
        )

    @cached_property
    def customers(self) -> DataFrame:
        lifetime = self.raw("orders").groupBy("o_custkey").agg(
            F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("spend")
        )
        balance = F.col("c_acctbal")
        segment = case(
            (balance >= 8000, "Champion"), (balance >= 6000, "Loyal"), (balance >= 4000, "Potential Loyalist"),
            (balance >= 2000, "Recent"), (balance >= 0, "At Risk"),
            default="Lost",
        )
        return (
            self.raw("customer")
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .join(lifetime, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("n_name").alias("city"),
                F.col("r_name").alias("city_tier"),
                F.col("c_mktsegment").alias("acquisition_channel"),
                F.coalesce("n", F.lit(0)).alias("total_orders"),
                F.coalesce("spend", F.lit(0.0)).alias("total_spend_inr"),
                (F.col("spend") / F.col("n")).alias("avg_order_value"),
                segment.alias("loyalty_segment"),
            )
        )

    @cached_property
    def stock(self) -> DataFrame:
        """Catalogue by size with opening stock and receipts."""
        pid, k = F.col("product_id"), position_in(SIZES, "size")
        return stock_grid(self.products).withColumns({
            "opening_stock": 20 + (pid * 7 + k * 13) % 80,
            "units_received": (pid * 3 + k * 5) % 40,
        })

    @cached_property
    def inventory(self) -> DataFrame:
        """Stock after what was dispatched: all lines but those of cancelled orders."""
        dispatched = self.placed.filter(F.col("order_status") != CANCELLED)
        return inventory_snapshot(self.stock, dispatched, as_of=STOCK_AS_OF, since=STOCK_SINCE, weeks=STOCK_WEEKS)

    @cached_property
    def marketing_spend(self) -> DataFrame:
        return self._marketing(self.raw("lineitem"))

    def marketing_spend_of(self, *years: int) -> DataFrame:
        """``marketing_spend`` from the first to the last of the years, as a date range that reaches the scan."""
        first, last = _span(years)
        day = F.col("l_shipdate").cast("date")
        return self._marketing(self.raw("lineitem").filter((day >= F.lit(first)) & (day <= F.lit(last))))

    def _marketing(self, lineitem: DataFrame) -> DataFrame:
        """Spend and attribution per month and region of the supplier.

        Lines are summed per supplier and month before the joins: a supplier with very many lines
        is one row per month there.
        """
        price = F.col("l_extendedprice")
        per_supplier = (
            lineitem
            .groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("month_start_date"))
            .agg(
                F.sum(price * (F.col("l_tax") + 0.01)).alias("spend"),
                F.sum(price * (1.0 - F.col("l_discount") * 4.0)).alias("revenue"),
                F.sum(F.col("l_quantity").cast("long")).alias("clicks"),
                F.count(F.lit(1)).alias("conversions"),
            )
        )
        monthly = (
            per_supplier
            .join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .groupBy("month_start_date", F.col("r_name").alias("marketing_channel"))
            .agg(
                (F.sum("spend") / 1e5).alias("spend_inr_lakhs"),
                (F.sum("revenue") / 5e5).alias("attributed_revenue_lakhs"),
                F.sum("clicks").alias("clicks"),
                F.sum("conversions").alias("conversions"),
            )
        )
        return marketing_efficiency(time_dims(monthly, "month_start_date"))

    def tables(self) -> Tables:
        """All tables at once, ``channel_revenue_monthly`` excepted: ``channel_monthly_rollup`` derives it."""
        return Tables(
            orders=self.orders, products=self.products, customers=self.customers,
            inventory=self.inventory, marketing_spend=self.marketing_spend,
        )
