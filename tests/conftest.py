from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.dir", str(base / "checkpoints"))
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def conf(spark):
    """Set session options for one test."""
    changed = {}

    def set_option(key, value):
        changed.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield set_option
    for key, value in changed.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


ORDER_DEFAULTS = {
    "order_id": "o1", "order_date": None, "year": 2024, "month": 1, "month_name": "Jan", "quarter": "Q1",
    "customer_id": "c1", "product_id": "p1", "category": "A", "channel": "Web", "size": "M", "quantity": 1,
    "mrp": 100.0, "discount_pct": 0.0, "selling_price": 100.0, "revenue_inr": 100.0, "gross_profit_inr": 50.0,
    "gross_margin_pct": 50.0, "order_status": "Delivered", "is_returned": False, "payment_method": "UPI",
}


@pytest.fixture()
def make(spark):
    """Rows as dicts -> a model table with its declared schema; missing columns take a default or NULL."""
    from shelfwise.sources.schema import SCHEMAS, columns_of

    def build(table, rows, **common):
        base = ORDER_DEFAULTS if table == "orders" else {}
        names = list(columns_of(table))
        data = []
        for row in rows:
            full = {**base, **common, **row}
            unknown = set(full) - set(names)
            assert not unknown, unknown
            data.append(tuple(full.get(n) for n in names))
        return spark.createDataFrame(data, SCHEMAS[table])

    return build


def records(df):
    return [row.asDict() for row in df.collect()]
