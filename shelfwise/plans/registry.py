"""Every operator as a query over the canonical model: name -> (spark, folder) -> DataFrame.

Each query runs over the whole tables. ``rounded`` is applied where an operator leaves values
unrounded, so that results can be compared by value.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures
from ..functions.numeric import rnd, rnd_all
from ..operators import (
    builders, customers, executive, inventory, marketing, pricing, quality, returns, sales, seasonality,
)
from ..operators.increments import Increments
from ..sources import batches, loader, rejects
from . import canonical as c
from .canonical import CanonicalModel
from .ranking import dense_numbers
from .session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BUILDS: dict[str, Callable[[CanonicalModel], DataFrame]] = {}
_MODELS: dict[tuple[str, int, str], CanonicalModel] = {}


def model_of(spark: SparkSession, folder: str) -> CanonicalModel:
    """The model of a folder, built once per session. It holds plans, never data."""
    key = (spark.sparkContext.applicationId, id(spark), folder)
    if key not in _MODELS:
        _MODELS[key] = CanonicalModel(spark, folder)
    return _MODELS[key]


def query(build: Callable[[CanonicalModel], DataFrame]) -> Query:
    """Register a function of the model under its own name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(model_of(spark, folder))

    run.__doc__ = build.__doc__
    QUERIES[build.__name__], BUILDS[build.__name__] = run, build
    return run


def rounded(df: DataFrame) -> DataFrame:
    return rnd_all(df, 4)


# Sources


@query
def table_counts(m):
    """Counting lines takes no order and no part."""
    return loader.table_counts(m.tables().present() | {"orders": m.lines})


@query
def delivered(m):
    return loader.delivered(m.placed).select(
        "order_id", "customer_id", "product_id", "size", "quantity", rnd("revenue_inr", 2).alias("revenue_inr")
    )


@query
def mart_quarterly_category(m):
    """Order lines written as a mart, loaded again, and reported on: the joins are paid once for all reports."""
    folder = f"{ensure_checkpoint_dir(m.spark)}/mart-{uuid.uuid4()}"
    loader.write_marts(loader.Tables(orders=m.orders), folder)
    return sales.quarterly_category(loader.load_tables(m.spark, folder, "parquet", ["orders"]).orders)


def kept_folder(m: CanonicalModel, name: str) -> str:
    """A shared folder of this application for marts of the model's tables, the same at every call."""
    tables = hashlib.sha256(m.folder.encode()).hexdigest()[:16]
    return f"{ensure_checkpoint_dir(m.spark)}/{name}-{m.spark.sparkContext.applicationId}-{tables}"


def batch_conditions() -> dict[str, Column]:
    """Three batches of whole orders that do not come in order of time: the earliest, and undated ones, come last."""
    day, cuts = F.col("order_date"), [F.lit(datetime.date(y, 1, 1)) for y in (1998, 2000)]
    return {"1998-1999": (day >= cuts[0]) & (day < cuts[1]), "2000-": day >= cuts[1], "-1997": (day < cuts[0]) | day.isNull()}


def in_batches(lines: DataFrame) -> dict[str, DataFrame]:
    """The lines of each of these batches."""
    return {name: lines.filter(condition) for name, condition in batch_conditions().items()}


@query
def refreshed_quarterly_category(m):
    """A mart loaded in batches, the last years twice: the second time nothing is written."""
    folder, parts = kept_folder(m, "refreshed"), in_batches(m.orders)
    for name in [*parts, "2000-"]:
        batches.refresh_mart(parts[name], folder, "orders", name)
    return sales.quarterly_category(batches.read_mart(m.spark, folder, "orders"))


def increments_of(m: CanonicalModel) -> Increments:
    return Increments(m.spark, kept_folder(m, "increments"))


def _sales_states(m: CanonicalModel) -> Increments:
    """Sums and sets of all batches, stored once per application. Lines are joined once for the sums and once for the sets."""
    kept, parts = increments_of(m), batch_conditions()
    kept.add_sales_batches(parts, m.orders)
    if kept.missing("sets", list(parts)):
        # in order of time, so that the orders of a quarter are near to each other; customers are numbered already
        dated = m.raw("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("day"))
        numbers = dense_numbers(dated, "order_id", ["day", "order_id"]).withColumnRenamed("number", "order_number")
        # joined with their part first, lines are where their order is when its number joins them
        lines = m.orders_of_every_status.join(numbers, "order_id", "left")
        kept.add_sets_batches(parts, lines, buyer_number="customer_id")
    return kept


@query
def states_category_contribution(m):
    """From stored sums and sets: no line is read."""
    return _sales_states(m).category_contribution(c.YEAR)


@query
def states_channel_performance(m):
    return _sales_states(m).channel_performance()


@query
def distinct_counts_by_grain(m):
    """Orders and buyers per quarter and category, channel and year, category, and in all, from one set of bitmaps."""
    return _sales_states(m).distinct_by_grain()


@query
def incremental_channel_rollup(m):
    """Month totals and first orders added up batch by batch, the earliest years last."""
    kept = increments_of(m)
    for name, lines in in_batches(m.placed).items():
        kept.add_months(name, lines)
    return kept.channel_monthly_rollup().withColumn("date", F.col("date").cast("string"))


@query
def incremental_cohorts(m):
    kept = increments_of(m)
    for name, lines in in_batches(m.placed).items():
        kept.add_customers(name, lines)
    return kept.cohort_repeat_rate()


@query
def csv_rejects(m):
    """The catalogue as CSV with planted faults, loaded again: accepted and rejected rows by reason."""
    part = m.raw("part").select(
        F.col("p_partkey").alias("n"), F.concat(F.lit("P"), "p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"), F.format_string("%.2f", "p_retailprice").alias("mrp"),
        F.col("p_size").cast("string").alias("initial_stock_units"), F.lit("2000-02-29").alias("launch_date"),
    )
    n, header = F.col("n"), part.columns[1:]
    broken = part.withColumns({
        "mrp": F.when(n % 10 == 0, "n/a").otherwise(F.col("mrp")), "launch_date": F.when(n % 15 == 0, "2001-02-29").otherwise(F.col("launch_date")),
        "initial_stock_units": F.when(n % 7 == 0, "1.5").otherwise(F.concat("initial_stock_units", F.lit(".0"))),
    })
    line = F.when(n % 11 == 0, F.to_csv(F.struct(*header[:-1]))).otherwise(F.to_csv(F.struct(*header)))
    folder = kept_folder(m, "csv")
    broken.select(line.alias("value")).write.mode("overwrite").text(f"{folder}/products.csv")
    good, bad = rejects.read_with_rejects(m.spark, folder, "products", header)
    outcome = good.select(F.lit("accepted").alias("outcome"), F.col("initial_stock_units").alias("units")).unionByName(
        bad.select(F.col("reason").alias("outcome"), F.lit(0).cast("bigint").alias("units"))
    )
    return outcome.groupBy("outcome").agg(F.count(F.lit(1)).alias("row_count"), F.sum("units").alias("units"))


@query
def preview(m):
    return rounded(loader.preview(m.products, 5, by=["product_id"]))


@query
def registered_views(m):
    """The tables through SQL: a report written against the registered views."""
    views = loader.register({"orders": m.placed, "products": m.products}, m.spark, prefix="shelfwise_")
    return m.spark.sql(
        f"""SELECT p.gender, o.quarter, COUNT(DISTINCT o.order_id) AS orders, SUM(o.quantity) AS units_sold
            FROM {views[0]} o JOIN {views[1]} p ON o.product_id = p.product_id
            WHERE o.order_status = 'Delivered' GROUP BY p.gender, o.quarter"""
    )


# Sales


@query
def monthly_revenue_mom(m):
    return sales.monthly_revenue_mom(m.placed)


@query
def category_contribution(m):
    return sales.category_contribution(m.orders_of(c.YEAR), c.YEAR)


@query
def top_products(m):
    return rounded(sales.top_products(m.orders, m.products, m.inventory))


@query
def top_products_by_revenue(m):
    return rounded(sales.top_products(m.orders, m.products, m.inventory, order_by="revenue"))


@query
def channel_performance(m):
    return sales.channel_performance(m.orders)


@query
def quarterly_category(m):
    return sales.quarterly_category(m.orders)


@query
def quarterly_category_pivot(m):
    return sales.quarterly_category(m.orders, pivot=True)


@query
def yoy_category_growth(m):
    return sales.yoy_category_growth(m.orders_of(*c.YEARS2), c.YEARS2)


@query
def rolling_ytd_revenue(m):
    return sales.rolling_ytd_revenue(m.placed)


@query
def festive_performance(m):
    return sales.festive_performance(m.orders)


@query
def kpi_by_year(m):
    return sales.kpi_by_year(m.orders_of(min(c.YEARS3) - 1, *c.YEARS3), c.YEARS3)


@query
def monthly_trend(m):
    return rounded(sales.monthly_trend(m.placed))


@query
def peak_month_by_year(m):
    return rounded(sales.peak_month_by_year(sales.monthly_trend(m.placed)))


@query
def calendar_bands(m):
    return rounded(sales.calendar_bands(sales.monthly_trend(m.placed)))


@query
def category_revenue_margin(m):
    return rounded(sales.category_revenue_margin(m.orders))


@query
def channel_mix_pivot(m):
    return rounded(sales.channel_mix_pivot(m.placed, c.CHANNELS))


@query
def hero_skus(m):
    return rounded(sales.hero_skus(m.orders, m.products))


@query
def yoy_growth_pivot(m):
    return rounded(sales.yoy_growth_pivot(m.orders_of(*c.YEARS2), c.YEARS2))


@query
def yoy_extremes(m):
    return sales.yoy_extremes(sales.yoy_growth_pivot(m.orders_of(*c.YEARS2), c.YEARS2))


# Inventory


@query
def inventory_health_by_category(m):
    return inventory.inventory_health_by_category(m.inventory)


@query
def overstock_alert(m):
    return rounded(inventory.overstock_alert(m.inventory, m.products))


@query
def overstock_alert_all(m):
    return rounded(inventory.overstock_alert(m.inventory, m.products, k=None))


@query
def reorder_priority(m):
    return rounded(inventory.reorder_priority(m.inventory, m.products))


@query
def size_curve_by_category(m):
    return rounded(inventory.size_curve_by_category(m.inventory, m.products))


@query
def sell_through_by_type_gender(m):
    return inventory.sell_through_by_type_gender(m.inventory, m.products)


@query
def sell_through_matrix(m):
    return inventory.sell_through_matrix(m.inventory, c.TYPES)


@query
def stock_health_distribution(m):
    return inventory.stock_health_distribution(m.inventory)


@query
def overstock_share(m):
    return inventory.overstock_share(m.inventory)


@query
def size_curve(m):
    return rounded(inventory.size_curve(m.inventory))


# Customers


@query
def rfm_segmentation(m):
    return customers.rfm_segmentation(m.placed, c.AS_OF)


@query
def rfm_segmentation_corrected(m):
    return customers.rfm_segmentation(m.placed, c.AS_OF, corrected=True)


@query
def cohort_repeat_rate(m):
    return customers.cohort_repeat_rate(m.placed)


@query
def category_by_loyalty(m):
    return customers.category_by_loyalty(m.orders, m.customers)


@query
def acquisition_effectiveness(m):
    return customers.acquisition_effectiveness(m.customers)


@query
def city_tier_mix(m):
    return customers.city_tier_mix(m.placed, m.customers)


@query
def loyalty_breakdown(m):
    return rounded(customers.loyalty_breakdown(m.customers))


@query
def champion_share(m):
    return customers.champion_share(m.customers)


# Pricing and margins


@query
def discount_bands(m):
    return pricing.discount_bands(m.orders)


@query
def discount_bands_contiguous(m):
    return pricing.discount_bands(m.orders, contiguous=True)


@query
def price_elasticity_proxy(m):
    return pricing.price_elasticity_proxy(m.orders)


@query
def licensed_margin(m):
    return pricing.licensed_margin(m.orders, m.products)


@query
def discount_margin_quadrants(m):
    return rounded(pricing.discount_margin_quadrants(m.orders))


# Seasonality


@query
def seasonality_index_avg(m):
    return rounded(seasonality.seasonality_index_avg(m.placed))


@query
def seasonality_index_sum(m):
    return rounded(seasonality.seasonality_index_sum(m.placed))


@query
def peak_months(m):
    """With a threshold of 1.0 the months above average: the test data has no strong season."""
    names = seasonality.peak_months(seasonality.seasonality_index_sum(m.placed), peak=1.0)
    return names.select(F.array_join("peak_months", ", ").alias("peak_months"))


# Marketing and returns


@query
def marketing_roas_quarterly(m):
    return marketing.marketing_roas_quarterly(m.marketing_spend)


@query
def marketing_roi_year(m):
    return rounded(marketing.marketing_roi_year(m.marketing_spend_of(c.YEAR), c.YEAR))


@query
def best_roas_channel(m):
    return marketing.best_roas_channel(marketing.marketing_roi_year(m.marketing_spend_of(c.YEAR), c.YEAR))


@query
def return_rate_category_channel(m):
    return returns.return_rate_category_channel(m.orders_of_every_status)


@query
def return_rate_matrix(m):
    return returns.return_rate_matrix(m.orders_of_every_status, c.CHANNELS)


@query
def overall_return_rate(m):
    return returns.overall_return_rate(m.lines)


# Executive


@query
def executive_kpi(m):
    return executive.executive_kpi(m.orders, m.marketing_spend)


@query
def executive_dashboard(m):
    return executive.executive_dashboard(m.orders_of(*c.YEARS3), c.YEARS3)


@query
def findings_summary(m):
    return executive.findings_summary(m.orders, m.inventory, m.customers, m.marketing_spend)


# The intended reading of reports whose customary formula says something else


@query
def monthly_revenue_mom_corrected(m):
    return sales.monthly_revenue_mom(m.placed, corrected=True)


@query
def top_products_corrected(m):
    return rounded(sales.top_products(m.orders, m.products, m.inventory, corrected=True))


@query
def channel_performance_corrected(m):
    return sales.channel_performance(m.orders, corrected=True)


@query
def rolling_ytd_revenue_corrected(m):
    return sales.rolling_ytd_revenue(m.placed, corrected=True)


@query
def kpi_by_year_corrected(m):
    return sales.kpi_by_year(m.orders_of(min(c.YEARS3) - 1, *c.YEARS3), c.YEARS3, corrected=True)


@query
def inventory_health_by_category_corrected(m):
    return inventory.inventory_health_by_category(m.inventory, corrected=True)


@query
def category_by_loyalty_corrected(m):
    return customers.category_by_loyalty(m.orders, m.customers, corrected=True)


@query
def city_tier_mix_corrected(m):
    return customers.city_tier_mix(m.placed, m.customers, corrected=True)


@query
def executive_kpi_corrected(m):
    return executive.executive_kpi(m.orders, m.marketing_spend, corrected=True)


# Measures and builders


@query
def line_measures(m):
    lines = m.costed.select(
        "order_id", "product_id", "size", "quantity", "discount_pct", "selling_price", "revenue_inr",
        "gross_profit_inr", "gross_margin_pct",
    )
    return rnd_all(lines, 2)


@query
def time_dims(m):
    dated = measures.time_dims(m.raw("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")), "d")
    return dated.select(
        F.col("o_orderkey").alias("order_id"), F.col("d").cast("string").alias("order_date"),
        "year", "month", "month_name", "quarter",
    )


@query
def product_margin(m):
    return rounded(m.products.select("product_id", "mrp", "cost_price", "gross_margin_pct"))


@query
def inventory_snapshot(m):
    return rounded(m.inventory)


@query
def customer_master(m):
    base = m.customers.select("customer_id", "city", "city_tier", "loyalty_segment")
    return rnd_all(builders.customer_master(base, m.orders_of_every_status), 2)


@query
def channel_monthly_rollup(m):
    rollup = builders.channel_monthly_rollup(m.placed)
    return rollup.withColumn("date", F.col("date").cast("string"))


@query
def marketing_efficiency(m):
    return rnd_all(m.marketing_spend.select("year", "month", "marketing_channel", "roas", "cpc_inr", "cac_inr"), 2)


# Quality


@query
def referential_check(m):
    """On the tables as they came, before any join could drop what has no partner."""
    checks = [
        ("lineitem.l_orderkey", "lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem.l_partkey", "lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem.l_suppkey", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("orders.o_custkey", "orders", "o_custkey", "customer", "c_custkey"),
    ]
    parts = [
        quality.referential_check(m.raw(fact), m.raw(dim).withColumnRenamed(dim_key, key), key).select(F.lit(name).alias("reference"), "*")
        for name, fact, key, dim, dim_key in checks
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def margin_identity_check(m):
    """The margin of lines, stored with one decimal, against price and cost: many are off by more than 0.04."""
    price, profit = F.col("selling_price"), F.col("gross_profit_inr") / F.col("quantity")
    stored = m.costed.select(price.alias("mrp"), (price - profit).alias("cost_price"), rnd("gross_margin_pct", 1).alias("gross_margin_pct"))
    return rounded(quality.margin_identity_check(stored, 0.04))


@query
def roas_identity_check(m):
    stored = m.marketing_spend.withColumn("roas", rnd("roas", 2))
    return rounded(quality.roas_identity_check(stored, 0.004))


@query
def key_uniqueness_check(m):
    return quality.key_uniqueness_check(m.lines, ["order_id", "product_id"])


@query
def wide_key_check(m):
    """Lines of a product that are alike in four more columns: hashes are shuffled, full keys only where one occurs twice."""
    return quality.wide_key_check(m.lines, ["product_id", "size", "quantity", "discount_pct", "is_returned"])
