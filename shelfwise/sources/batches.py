"""Marts that are loaded batch by batch, each batch once.

A load writes its rows to a folder of its own, ``<name>/rows/load=<id>``, partitioned by year, and only then adds a
row to the mart's log. Nothing is overwritten: a load that fails leaves no row in the log, so what was there
before stays as it was and is still read; late lines add files to their years alone. A batch that is loaded already is not
loaded again, unless it is to be replaced: its newest load then counts, from the moment it is in the log.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = "batch string, version bigint, load string, row_count bigint, schema string"


def _folder(path: str, name: str, part: str) -> str:
    return f"{path}/{name}/{part}"


def mart_log(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Every load of a mart, in order of ``version``; empty if there was none."""
    try:
        return spark.read.schema(LOG).parquet(_folder(path, name, "log"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def current_loads(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The load that counts for each batch: (batch, version, load, row_count, schema)."""
    newest = F.max(F.struct("version", "load", "row_count", "schema")).alias("newest")
    return mart_log(spark, path, name).groupBy("batch").agg(newest).select("batch", "newest.*")


def refresh_mart(
    df: DataFrame, path: str, name: str, batch: str, partition_by: tuple[str, ...] = ("year",), replace: bool = False
) -> bool:
    """Load ``df`` as a batch of a mart; False if that batch was loaded before and is not to be replaced.

    Rows are rebalanced by the partition columns: few files a folder, and a year that holds most rows is
    still written by many tasks. A batch that has been compacted with others cannot be replaced.
    """
    spark = df.sparkSession
    loads = current_loads(spark, path, name)
    sharing = F.collect_list(F.when(F.col("batch") == batch, F.col("load")))
    held = loads.agg(sharing.alias("own"), F.collect_list("load").alias("all")).first()
    if held["own"]:
        if not replace:
            return False
        if held["all"].count(held["own"][0]) > 1:
            raise ValueError(f"batch {batch!r} of {name!r} was compacted with others")
    _log(spark, path, name, [batch], _write(df, path, name, partition_by))
    return True


def _write(df: DataFrame, path: str, name: str, partition_by: tuple[str, ...]) -> tuple[str, int, str]:
    """The load's id, its number of rows (counted while they are written) and its schema."""
    load, seen = uuid.uuid4().hex, Observation()
    counted = df.hint("rebalance", *partition_by).observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{_folder(path, name, 'rows')}/load={load}")
    return load, seen.get["rows"], df.schema.json()


def _log(spark: SparkSession, path: str, name: str, batches: list[str], written: tuple[str, int, str]) -> None:
    """One file with a row per batch: a reader sees all of them or none."""
    load, rows, schema = written
    version = mart_log(spark, path, name).agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
    entries = [(batch, version, load, rows, schema) for batch in batches]
    spark.createDataFrame(entries, LOG).coalesce(1).write.mode("append").parquet(_folder(path, name, "log"))


def read_mart(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of all batches, each by its newest load, with the types they were written with.

    Only folders in the log are listed; a filter on a partition column prunes them further. The driver holds an id
    of 32 letters per load.
    """
    loads = current_loads(spark, path, name)
    newest = loads.agg(F.sort_array(F.collect_set("load")), F.max_by("schema", "version")).first()
    if not newest[0]:
        raise ValueError(f"nothing was loaded into {name!r} below {path!r}")
    rows = _folder(path, name, "rows")
    schema = StructType.fromJson(json.loads(newest[1]))
    return spark.read.schema(schema).option("basePath", rows).parquet(*(f"{rows}/load={load}" for load in newest[0])).select(*schema.names)


def compact_mart(
    spark: SparkSession, path: str, name: str, combine: Callable[[DataFrame], DataFrame] | None = None, partition_by: tuple[str, ...] = ("year",)
) -> None:
    """Write all batches as one load: fewer files, and with ``combine`` (states of several loads into one) fewer rows.

    The batches count as loaded as before. The loads that were replaced keep their files, so that reports under way can end.
    """
    names = current_loads(spark, path, name).agg(F.sort_array(F.collect_list("batch"))).first()[0]
    rows = read_mart(spark, path, name)
    _log(spark, path, name, names, _write(combine(rows) if combine else rows, path, name, partition_by))
