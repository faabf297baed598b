"""Declared columns and types of the six tables: no inference pass over the files.

Counts are bigint throughout, so that sums never overflow. Schemas are DDL strings: importing
this module needs no running Spark.
"""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "orders": (
        "order_id string, order_date date, year bigint, month bigint, month_name string, quarter string, "
        "customer_id string, product_id string, category string, channel string, size string, quantity bigint, "
        "mrp double, discount_pct double, selling_price double, revenue_inr double, gross_profit_inr double, "
        "gross_margin_pct double, order_status string, is_returned boolean, payment_method string"
    ),
    "products": (
        "product_id string, product_name string, category string, product_type string, gender string, mrp double, "
        "cost_price double, gross_margin_pct double, launch_date date, is_licensed boolean, is_active boolean, "
        "initial_stock_units bigint, fabric string, fit string, hsn_code bigint"
    ),
    "customers": (
        "customer_id string, city string, state string, city_tier string, acquisition_channel string, "
        "total_orders bigint, total_spend_inr double, avg_order_value double, loyalty_segment string, "
        "preferred_category string, preferred_size string"
    ),
    "inventory": (
        "product_id string, category string, product_type string, size string, opening_stock bigint, "
        "units_received bigint, units_sold bigint, closing_stock bigint, sell_through_pct double, "
        "rate_of_sale_per_week double, weeks_of_cover double, stock_health_status string, "
        "reorder_recommended boolean, stock_value_at_cost double, stock_value_at_mrp double"
    ),
    "marketing_spend": (
        "month_start_date date, year bigint, month bigint, month_name string, quarter string, "
        "marketing_channel string, spend_inr_lakhs double, attributed_revenue_lakhs double, roas double, "
        "impressions bigint, clicks bigint, conversions bigint, cpc_inr double, cac_inr double"
    ),
    "channel_revenue_monthly": (
        "date date, year bigint, month bigint, month_name string, quarter string, channel string, gmv_lakhs double, "
        "net_revenue_lakhs double, total_orders bigint, avg_order_value_inr double, units_sold bigint, "
        "new_customer_orders bigint, repeat_customer_orders bigint, return_rate_pct double, "
        "discount_rate_pct double, avg_items_per_order double"
    ),
}

TABLES = tuple(SCHEMAS)


def columns_of(table: str) -> dict[str, str]:
    """Column name -> type of a table."""
    return dict(column.split() for column in SCHEMAS[table].split(","))
