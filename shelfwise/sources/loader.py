"""Read the six tables, register them for SQL, preview, count and write them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.domains import DELIVERED
from .schema import TABLES, columns_of


@dataclass(frozen=True)
class Tables:
    """The model's tables. A table that was not shipped is None."""

    orders: DataFrame | None = None
    products: DataFrame | None = None
    customers: DataFrame | None = None
    inventory: DataFrame | None = None
    marketing_spend: DataFrame | None = None
    channel_revenue_monthly: DataFrame | None = None

    def present(self) -> dict[str, DataFrame]:
        pairs = ((f.name, getattr(self, f.name)) for f in fields(self))
        return {name: df for name, df in pairs if df is not None}


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "csv") -> DataFrame:
    """The known columns of one table, found by name and cast to their declared types.

    CSV is ``<name>.csv`` (a file or a folder of files) with a header; types are never inferred from the
    data, and a value that does not fit its type is an error, not a NULL. Parquet is ``<name>.parquet``.
    Columns may come in any order; further ones are not read, and an absent one is simply not there.
    """
    if fmt == "csv":
        df = spark.read.options(header=True, enforceSchema=False, mode="FAILFAST").csv(f"{path}/{name}.csv")
    elif fmt == "parquet":
        df = spark.read.parquet(f"{path}/{name}.parquet")
    else:
        raise ValueError(f"unknown format {fmt!r}: use 'csv' or 'parquet'")
    present = set(df.columns)
    return df.select(*[_typed(df, c, t).alias(c) for c, t in columns_of(name).items() if c in present])


def _typed(df: DataFrame, name: str, kind: str) -> Column:
    column = df[name]
    if kind == "bigint" and dict(df.dtypes)[name] == "string":
        column = column.cast("decimal(38,6)")  # counts with gaps are often written as 12.0
    return column.cast(kind)


def load_tables(
    spark: SparkSession, path: str, fmt: str = "csv", names: Iterable[str] = TABLES
) -> Tables:
    """Load the named tables (all six by default) from one folder."""
    return Tables(**{name: read_table(spark, path, name, fmt) for name in names})


def register(tables: Tables | Mapping[str, DataFrame], spark: SparkSession, database: str | None = None,
             prefix: str = "") -> list[str]:
    """Make the tables known to ``spark.sql`` as temporary views, after creating and using ``database``.

    Returns the view names.
    """
    if database is not None:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        spark.sql(f"USE `{database}`")
    frames = tables.present() if isinstance(tables, Tables) else dict(tables)
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in frames]


def register_marts(spark: SparkSession, path: str, database: str, names: Iterable[str] = TABLES) -> list[str]:
    """Make the folder of ``write_marts`` known as tables of ``database``, which is created if need be.

    The tables stay in the catalog for other sessions and applications that share it; dropping them leaves the files. A
    table that is known already is made known anew, with the files that are there now. Returns their full names.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    made = []
    for name in names:
        table = f"{database}.{name}"
        df = spark.read.parquet(f"{path}/{name}.parquet")
        if spark.catalog.tableExists(table):
            spark.sql(f"DROP TABLE `{database}`.`{name}`")
        spark.catalog.createTable(table, path=f"{path}/{name}.parquet", source="parquet", schema=df.schema)
        made.append(table)
    return made


def delivered(orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    """The shared subset of the sales reports. Lazy: each report scans only its own columns."""
    return orders.filter(F.col("order_status") == status)


def table_counts(tables: Tables | Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table, one job for all of them."""
    frames = tables.present() if isinstance(tables, Tables) else dict(tables)
    counts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
              for name, df in frames.items()]
    return reduce(DataFrame.unionByName, counts)


def preview(df: DataFrame, n: int = 5, by: list[Column | str] | None = None) -> DataFrame:
    """The first ``n`` rows; with ``by`` they are the smallest ones and always the same."""
    return df.limit(n) if by is None else df.orderBy(*by).limit(n)


def write_mart(df: DataFrame, path: str, name: str, partition_by: tuple[str, ...] = ("year",)) -> str:
    """Write a table as parquet partitioned by ``partition_by``, so that year filters prune directories.

    Rows are rebalanced by the partition columns first: few files per directory, and a year
    that holds most of the rows is still split over many tasks. A folder that is already
    there is not overwritten: the write fails.
    """
    target = f"{path}/{name}.parquet"
    df.hint("rebalance", *partition_by).write.mode("errorifexists").partitionBy(*partition_by).parquet(target)
    return target


def write_marts(tables: Tables, path: str) -> dict[str, str]:
    """Write every table; those with a ``year`` are partitioned by it. ``load_tables(..., "parquet")`` reads them.

    Order lines that come from joins are joined here once, and the reports then only scan them.
    """
    return {
        name: write_mart(df, path, name, ("year",) if "year" in df.columns else ())
        for name, df in tables.present().items()
    }
