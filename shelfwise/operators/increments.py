"""Reports kept up to date batch by batch: what each batch adds is stored, and no report reads order lines.

``Increments`` is a folder of marts (``sources.batches``) of additive states. A batch is any set of whole orders: a
month, a day, or late ones; batches may come in any order, as sums, least values and unions do not depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import case, rnd
from ..functions.states import combined, distinct_counts, distinct_states, mean, sales_states, united
from ..plans.session import ensure_checkpoint_dir
from ..sources.batches import compact_mart, current_loads, read_mart, refresh_mart
from ..sources.loader import delivered
from .builders import MONTH_SUMS, first_orders, month_totals, per_order, rollup_report
from .customers import cohort_report
from .sales import channel_report, contribution_report

#: The grain of the stored sales, and of the stored sets of orders and buyers.
SALES_GRAIN = ("year", "quarter", "month", "category", "channel", "discount_pct")
SET_GRAIN = ("year", "quarter", "category", "channel")


@dataclass(frozen=True)
class Increments:
    """States of order lines below a folder; each mart takes a batch once, however often it is sent."""

    spark: SparkSession
    folder: str

    def add_sales(self, batch: str, lines: DataFrame) -> bool:
        """Sums of delivered lines. True if the batch was new."""
        return bool(self.add_sales_batches({batch: F.lit(True)}, lines))

    def add_sets(self, batch: str, lines: DataFrame, order_number: str = "order_number", buyer_number: str = "customer_number") -> bool:
        """Sets of orders and buyers of delivered lines, which hold their dense numbers."""
        return bool(self.add_sets_batches({batch: F.lit(True)}, lines, order_number, buyer_number))

    def add_sales_batches(self, batches: Mapping[str, Column], lines: DataFrame) -> list[str]:
        """``add_sales`` for several batches, whose lines a condition each tells, from one pass over ``lines``. The names of the new ones."""
        return self._add_batches("sales", batches, lines, lambda rows, batch: sales_states(rows, [batch, *SALES_GRAIN]))

    def add_sets_batches(
        self, batches: Mapping[str, Column], lines: DataFrame, order_number: str = "order_number", buyer_number: str = "customer_number"
    ) -> list[str]:
        """``add_sets`` for several batches from one pass."""
        numbers = {"orders": order_number, "buyers": buyer_number}
        return self._add_batches("sets", batches, lines, lambda rows, batch: distinct_states(rows, [batch, *SET_GRAIN], numbers))

    def missing(self, name: str, batches: Sequence[str]) -> list[str]:
        """Those of the batches that a mart does not hold."""
        held = current_loads(self.spark, self.folder, name).agg(F.collect_set("batch")).first()[0]
        return [batch for batch in batches if batch not in held]

    def _add_batches(
        self, name: str, batches: Mapping[str, Column], lines: DataFrame, states_of: Callable[[DataFrame, str], DataFrame]
    ) -> list[str]:
        """The states of all new batches are made at once, kept, and loaded from there batch by batch."""
        new = self.missing(name, list(batches))
        if not new:
            return new
        wanted = delivered(lines).filter(reduce(or_, [batches[b] for b in new]))
        batch = "batch_number"
        states = states_of(wanted.withColumn(batch, case(*[(batches[b], i) for i, b in enumerate(new)])), batch)
        if len(new) > 1:
            ensure_checkpoint_dir(self.spark)
            states = states.checkpoint(eager=True)
        return [b for i, b in enumerate(new) if refresh_mart(states.filter(F.col(batch) == i).drop(batch), self.folder, name, b)]

    def add_months(self, batch: str, lines: DataFrame) -> bool:
        """Totals of months and channels, and the batch's first order of each customer; lines of every status."""
        placed = per_order(lines)
        totals = refresh_mart(month_totals(placed), self.folder, "months", batch, ())
        return refresh_mart(first_orders(placed), self.folder, "first_orders", batch, ()) or totals

    def add_customers(self, batch: str, lines: DataFrame) -> bool:
        """Number of orders and first day of each customer; delivered lines."""
        states = delivered(lines).groupBy("customer_id").agg(
            F.countDistinct("order_id").alias("order_count"), F.min("order_date").alias("first_order_date")
        )
        return refresh_mart(states, self.folder, "customers", batch, ())

    def sales(self) -> DataFrame:
        return read_mart(self.spark, self.folder, "sales")

    def sets(self) -> DataFrame:
        return read_mart(self.spark, self.folder, "sets")

    def compact(self) -> None:
        """One load per mart that was begun, with one state per group: what reports read stops growing with the batches."""
        steps = {
            "sales": (lambda s: combined(s, SALES_GRAIN), ("year",)), "sets": (lambda s: united(s, SET_GRAIN), ("year",)),
            "months": (_month_sums, ()), "first_orders": (_earliest, ()), "customers": (_lifetimes, ()),
        }
        for name, (combine, partition_by) in steps.items():
            try:
                compact_mart(self.spark, self.folder, name, combine, partition_by)
            except ValueError:
                continue  # nothing was loaded

    # reports

    def _grouped(self, dims: Sequence[str], states: DataFrame, sets: DataFrame) -> DataFrame:
        """Combined sums and distinct counts of the same groups, NULL groups included."""
        sums, counts = combined(states, dims), distinct_counts(sets, dims, ("orders", "buyers"))
        same = [sums[d].eqNullSafe(counts[d]) for d in dims]
        return sums.join(counts, same, "left").drop(*[counts[d] for d in dims]).fillna(0, ["orders", "buyers"])

    def category_contribution(self, year: int) -> DataFrame:
        """``sales.category_contribution``."""
        of = lambda states: states.filter(F.col("year") == year)
        per = self._grouped(["category"], of(self.sales()), of(self.sets()))
        discount = rnd(mean("discount"), 1).alias("avg_discount_pct")
        return contribution_report(
            per.select("category", F.col("orders").alias("total_orders"), F.col("units").alias("units_sold"), "revenue", "profit", discount)
        )

    def channel_performance(self) -> DataFrame:
        """``sales.channel_performance``."""
        per = self._grouped(["channel", "year"], self.sales(), self.sets())
        return channel_report(per.select(
            "channel", "year", F.col("orders").alias("total_orders"), F.col("units").alias("units_sold"), "revenue", "profit",
            rnd(mean("price"), 0).alias("avg_order_value"), rnd(mean("discount"), 1).alias("avg_discount_pct"),
        ))

    def distinct_by_grain(self) -> DataFrame:
        """Orders and buyers at three grains and over all, from the same sets."""
        grains = (["year", "quarter", "category"], ["year", "channel"], ["category"], [])
        parts = [
            distinct_counts(self.sets(), grain, ("orders", "buyers")).select(
                F.lit(", ".join(grain)).alias("grain"),
                *[(F.col(d) if d in grain else F.lit(None)).cast("string").alias(d) for d in SET_GRAIN], "orders", "buyers",
            )
            for grain in grains
        ]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def channel_monthly_rollup(self) -> DataFrame:
        """``builders.channel_monthly_rollup``: a late earlier order makes another one the customer's first."""
        months = _month_sums(read_mart(self.spark, self.folder, "months"))
        return rollup_report(months, _earliest(read_mart(self.spark, self.folder, "first_orders")))

    def cohort_repeat_rate(self) -> DataFrame:
        """``customers.cohort_repeat_rate``."""
        return cohort_report(_lifetimes(read_mart(self.spark, self.folder, "customers")))


def _month_sums(months: DataFrame) -> DataFrame:
    return months.groupBy("month_start_date", "channel").agg(*[F.sum(n).alias(n) for n in ("total_orders", *MONTH_SUMS)])


def _earliest(first: DataFrame) -> DataFrame:
    return first.groupBy("customer_id").agg(F.min("first").alias("first"))


def _lifetimes(customers: DataFrame) -> DataFrame:
    return customers.groupBy("customer_id").agg(F.sum("order_count").alias("order_count"), F.min("first_order_date").alias("first_order_date"))
