"""Reading, registering, counting and writing the tables; golden values when the CSV files are at hand."""

from __future__ import annotations

import os
import pathlib
import subprocess
import sys

import pytest
from pyspark.errors import AnalysisException

from shelfwise.operators import customers, executive, inventory, marketing, pricing, quality, sales
from shelfwise.plans import session
from shelfwise.plans.canonical import CanonicalModel
from shelfwise.sources import Tables, delivered, load_tables, preview, register, register_marts, table_counts, write_mart, write_marts
from shelfwise.sources.schema import SCHEMAS, columns_of

from .conftest import TESTDATA, records

BESIDE = pathlib.Path(__file__).resolve().parents[2] / "reference"
CSV_DIR = os.environ.get("RETAIL_CSV_DIR") or (str(BESIDE) if (BESIDE / "products.csv").exists() else None)
PRODUCTS = """product_id,product_name,category,product_type,gender,mrp,cost_price,gross_margin_pct,launch_date,is_licensed,is_active,initial_stock_units,fabric,fit,hsn_code
p1,"Mug, large",Basics,Mug,Men,100,40.0,60.0,2024-01-31,True,False,7,Clay,Round,1
p2,Cap,Basics,Cap,Women,50,,,,False,True,,Felt,Wide,2
"""


def test_import_needs_no_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_schemas_are_well_formed(make):
    for name in SCHEMAS:
        assert dict(make(name, []).dtypes) == columns_of(name)


def test_csv_types(spark, tmp_path):
    (tmp_path / "products.csv").write_text(PRODUCTS)
    products = load_tables(spark, str(tmp_path), names=["products"]).products
    assert dict(products.dtypes) == columns_of("products")
    mug, cap = records(products.orderBy("product_id"))
    assert (mug["product_name"], mug["is_licensed"], mug["is_active"], str(mug["launch_date"])) == ("Mug, large", True, False, "2024-01-31")
    assert (cap["cost_price"], cap["launch_date"], cap["initial_stock_units"]) == (None, None, None)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "products.csv").write_text("mrp,note,product_id,initial_stock_units\n100,x,p1,12.0\n50,,p2,\n")
    products = load_tables(spark, str(tmp_path), names=["products"]).products
    assert products.columns == ["product_id", "mrp", "initial_stock_units"]
    assert sorted(map(tuple, products.collect())) == [("p1", 100.0, 12), ("p2", 50.0, None)]
    with pytest.raises(AnalysisException):
        products.select("gender")


def test_csv_value_of_the_wrong_type_fails(spark, tmp_path):
    (tmp_path / "products.csv").write_text("product_id,mrp\np1,cheap\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_tables(spark, str(tmp_path), names=["products"]).products.collect()


def test_reports_on_csv_equal_those_on_frames(spark, tmp_path):
    model = CanonicalModel(spark, f"{TESTDATA}/sf0.001")
    for name, df in model.tables().present().items():
        df.write.option("header", True).csv(f"{tmp_path}/{name}.csv")
    read = load_tables(spark, str(tmp_path), names=model.tables().present())
    assert dict(read.orders.dtypes)["order_date"] == "date"
    for report in (
        lambda m: executive.executive_kpi(m.orders, m.marketing_spend),
        lambda m: customers.city_tier_mix(m.orders, m.customers),
        lambda m: inventory.sell_through_by_type_gender(m.inventory, m.products),
    ):
        assert sorted(map(str, report(read).collect())) == sorted(map(str, report(model).collect()))


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        load_tables(spark, str(tmp_path), fmt="xml", names=["products"])


def test_mart_round_trip_prunes_years(spark, make, tmp_path):
    lines = make("orders", [{"order_id": f"o{k}", "year": 2020 + k % 3, "quantity": k} for k in range(30)])
    write_mart(lines, str(tmp_path), "orders")
    assert {p.name for p in (tmp_path / "orders.parquet").iterdir() if p.is_dir()} == {f"year={y}" for y in (2020, 2021, 2022)}
    back = load_tables(spark, str(tmp_path), "parquet", ["orders"]).orders
    assert dict(back.dtypes) == columns_of("orders")
    assert sorted(map(str, back.collect())) == sorted(map(str, lines.collect()))
    plan = back.filter("year = 2021")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    with pytest.raises(AnalysisException):
        write_mart(lines, str(tmp_path), "orders")


def test_reports_on_marts_equal_those_on_joins(spark, tmp_path):
    model = CanonicalModel(spark, f"{TESTDATA}/sf0.001")
    write_marts(model.tables(), str(tmp_path))
    marts = load_tables(spark, str(tmp_path), "parquet", model.tables().present())
    reports = {
        "executive": lambda m: executive.executive_kpi(m.orders, m.marketing_spend),
        "findings": lambda m: executive.findings_summary(m.orders, m.inventory, m.customers, m.marketing_spend),
        "stock": lambda m: inventory.inventory_health_by_category(m.inventory),
        "loyalty": lambda m: customers.category_by_loyalty(m.orders, m.customers),
        "licensed": lambda m: pricing.licensed_margin(m.orders, m.products),
    }
    for name, report in reports.items():
        on_marts = report(marts)
        assert sorted(map(str, on_marts.collect())) == sorted(map(str, report(model).collect())), name
    plan = sales.category_contribution(marts.orders, 2000)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "(year#" in plan[plan.index("PartitionFilters"):][:80]


def test_register_and_sql(spark, make):
    before = spark.catalog.currentDatabase()
    try:
        lines = make("orders", [{}, {"order_status": "Cancelled"}])
        assert register(Tables(orders=lines), spark, database="retail_test") == ["orders"]
        assert spark.catalog.currentDatabase() == "retail_test"
        assert spark.sql("SELECT SUM(revenue_inr) FROM orders WHERE order_status = 'Delivered'").first()[0] == 100.0
    finally:
        spark.catalog.setCurrentDatabase(before)
        spark.catalog.dropTempView("orders")
        spark.sql("DROP DATABASE IF EXISTS retail_test")


def test_marts_are_tables_of_the_database(spark, make, tmp_path):
    lines = make("orders", [{"order_id": f"o{k}", "year": 2020 + k % 3} for k in range(6)] + [{"order_status": "Cancelled", "year": 2020}])
    write_marts(Tables(orders=lines, products=make("products", [{"product_id": "p1"}])), str(tmp_path))
    try:
        assert register_marts(spark, str(tmp_path), "mart_test", ["orders", "products"]) == ["mart_test.orders", "mart_test.products"]
        other = spark.newSession()
        assert {t.name for t in other.catalog.listTables("mart_test")} == {"orders", "products"}
        found = other.sql("SELECT year, COUNT(*) AS n FROM mart_test.orders WHERE order_status = 'Delivered' GROUP BY year")
        assert {r["year"]: r["n"] for r in records(found)} == {2020: 2, 2021: 2, 2022: 2}
        assert other.table("mart_test.orders").filter("year = 2021").count() == 2
    finally:
        spark.sql("DROP DATABASE IF EXISTS mart_test CASCADE")


def test_counts_subset_preview(make):
    lines = make("orders", [{"order_id": o, "order_status": s} for o, s in (("b", "Delivered"), ("a", "Returned"), ("c", None))])
    assert records(table_counts(Tables(orders=lines, customers=make("customers", [])))) == [
        {"table_name": "orders", "row_count": 3}, {"table_name": "customers", "row_count": 0},
    ]
    assert [r["order_id"] for r in records(delivered(lines))] == ["b"]
    assert [r["order_id"] for r in records(preview(lines, 2, by=["order_id"]))] == ["a", "b"]
    assert preview(lines, 2).count() == 2


def test_checkpoint_folder_comes_from_the_session(spark):
    assert session.ensure_checkpoint_dir(spark).startswith("file:" + spark.conf.get("spark.checkpoint.dir"))


def test_no_local_checkpoint_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


needs_csv = pytest.mark.skipif(not CSV_DIR, reason="no folder with the CSV files: set RETAIL_CSV_DIR")


@needs_csv
def test_golden_marketing_2024(spark):
    spend = load_tables(spark, CSV_DIR, names=["marketing_spend"]).marketing_spend
    roi = [(r["marketing_channel"], round(r["spend_lakhs"], 2), round(r["revenue_lakhs"], 2), r["roas"], round(r["avg_cac_inr"], 2), r["tier"])
           for r in records(marketing.marketing_roi_year(spend))]
    assert roi == [
        ("Offline / Events", 31.88, 59.93, 1.88, 24218.08, "<3"),
        ("Influencer Marketing", 146.34, 409.15, 2.80, 13208.83, "<3"),
        ("Meta Ads", 227.19, 716.68, 3.15, 16407.17, "3–4.5"),
        ("Affiliate", 59.41, 222.11, 3.74, 20475.0, "3–4.5"),
        ("Google Ads", 163.71, 666.45, 4.07, 13659.08, "3–4.5"),
        ("SEO / Content", 42.68, 217.24, 5.09, 13265.83, "≥4.5"),
        ("Email / WhatsApp", 76.37, 505.35, 6.62, 13490.0, "≥4.5"),
    ]
    quarterly = marketing.marketing_roas_quarterly(spend)
    assert quarterly.count() == 84
    first = records(quarterly.filter("year = 2024 AND quarter = 'Q1' AND marketing_channel = 'Affiliate'"))[0]
    assert (first["total_spend_lakhs"], first["attributed_revenue_lakhs"], first["blended_roas"], first["avg_cac_inr"],
            first["total_conversions"]) == (14.41, 54.41, 3.78, 34121.0, 152)
    last = records(quarterly.filter("year = 2024 AND quarter = 'Q4' AND marketing_channel = 'Meta Ads'"))[0]
    assert (last["total_spend_lakhs"], last["attributed_revenue_lakhs"], last["blended_roas"], last["avg_cac_inr"],
            last["total_conversions"]) == (73.46, 238.87, 3.25, 11642.0, 760)


@needs_csv
def test_golden_executive_and_findings(spark, make):
    spend = load_tables(spark, CSV_DIR, names=["marketing_spend"]).marketing_spend
    lines = make("orders", [{"year": y} for y in (2022, 2023, 2024)])
    roas = {r["year"]: r["blended_roas"] for r in records(executive.executive_kpi(lines, spend))}
    assert roas == {2022: 3.70, 2023: 3.77, 2024: 3.74}
    row, = records(executive.findings_summary(lines, make("inventory", []), make("customers", []), spend))
    assert (row["blended_roas"], row["best_roas_channel"]) == (3.74, "Email / WhatsApp")


@needs_csv
def test_golden_products(spark):
    tables = load_tables(spark, CSV_DIR, names=["products", "marketing_spend", "channel_revenue_monthly"])
    products = tables.products
    assert {r["table_name"]: r["row_count"] for r in records(table_counts(tables))} == {
        "products": 150, "marketing_spend": 252, "channel_revenue_monthly": 216,
    }
    assert products.filter("is_licensed").count() == 120
    assert products.select("product_name").distinct().count() == 80
    assert {r["count"] for r in records(products.groupBy("category").count())} == {15}
    assert records(quality.margin_identity_check(products))[0]["mismatches"] == 0
    assert records(quality.key_uniqueness_check(products, ["product_id"])) == []
    assert records(quality.roas_identity_check(tables.marketing_spend, 0.0050000001))[0]["mismatches"] == 19
