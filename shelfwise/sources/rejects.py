"""A CSV load that survives bad rows: what fits the table's types is loaded, every other line is kept with its reason."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import case
from .loader import Tables
from .schema import TABLES, columns_of

REJECTS = ("table_name", "file", "line", "reason")
COLUMN_COUNT = "number of columns"
_CORRUPT, _WHY = "_corrupt", "_why"


def read_with_rejects(spark: SparkSession, path: str, name: str, header: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the table ``<name>.csv``, rejects): every line but blank ones and headers is in exactly one of them.

    A row fits if it has as many columns as the header and each known column's value has its declared type or is empty;
    columns are found by name, further ones are not read. Rejects are (table_name, file, line, reason): the line as it
    is in the file, and all that is wrong with it, separated by semicolons. ``header`` names the columns of files
    without a header line. Both frames are lazy; write one of them out if both are large and needed often.
    """
    source = f"{path}/{name}.csv"
    lines = spark.read.text(source).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    if header is None:
        reader = spark.read.option("header", True).csv(source)
        header = reader.columns
        titles = F.from_csv("value", ", ".join(f"`c{i}` string" for i in range(len(header))))
        # a line that says just the names is a header, in whichever file it stands
        lines = lines.filter(~F.coalesce(reduce(lambda a, b: a & b, [titles[f"c{i}"] == h for i, h in enumerate(header)]), F.lit(False)))
    fields = ", ".join([*(f"`{c}` string" for c in header), f"`{_CORRUPT}` string"])
    parsed = lines.withColumn("row", F.from_csv("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))
    known = {c: kind for c, kind in columns_of(name).items() if c in header}
    typed = {c: _tried(c, kind) for c, kind in known.items()}
    bad = [F.when(F.col("row")[c].isNotNull() & typed[c].isNull(), F.lit(f"{c} is no {kind}")) for c, kind in known.items() if kind != "string"]
    shape = F.when(F.col("row")[_CORRUPT].isNotNull(), F.lit(COLUMN_COUNT))
    judged = parsed.withColumn(_WHY, F.when(shape.isNotNull(), shape).otherwise(F.concat_ws("; ", *bad)))
    good = judged.filter(F.col(_WHY) == "").select(*[value.alias(c) for c, value in typed.items()])
    rejects = judged.filter(F.col(_WHY) != "").select(F.lit(name).alias("table_name"), "file", F.col("value").alias("line"), F.col(_WHY).alias("reason"))
    return good, rejects


def _tried(name: str, kind: str):
    value = F.col("row")[name]
    if kind == "bigint":  # counts with gaps are often written as 12.0, but 12.5 is none
        number = value.try_cast("decimal(38,6)")
        return case((number == F.floor(number), number.try_cast("bigint")))
    return value.try_cast(kind)


def load_with_rejects(spark: SparkSession, path: str, names: Iterable[str] = TABLES) -> tuple[Tables, DataFrame]:
    """The named tables of a folder and the rejects of all of them."""
    pairs = {name: read_with_rejects(spark, path, name) for name in names}
    return Tables(**{name: good for name, (good, _) in pairs.items()}), reduce(DataFrame.unionByName, [bad for _, bad in pairs.values()])
