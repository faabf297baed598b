"""Checks of keys and identities the tables promise but do not enforce. Each returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where, ratio


def referential_check(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys of ``fact`` without a partner in ``dim``; NULL keys apart.

    Rows are counted per key before the join, so a key on a third of the rows is one row in it.
    """
    per_key = fact.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = dim.select(key).distinct().withColumn("known", F.lit(True))
    orphan = F.col("known").isNull() & F.col(key).isNotNull()
    return per_key.join(known, key, "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("checked_rows"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_key_rows"),
        F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("orphan_rows"),
        count_where(orphan).alias("orphan_keys"),
    )


def _identity_check(df: DataFrame, stored: str, expected: Column, tolerance: float) -> DataFrame:
    off = F.abs(F.col(stored) - expected)
    return df.agg(
        F.count(F.lit(1)).alias("checked_rows"),
        count_where(off > tolerance).alias("mismatches"),
        F.max(off).alias("max_difference"),
    )


def margin_identity_check(products: DataFrame, tolerance: float = 0.051) -> DataFrame:
    """Stored list margin against (MRP - cost) / MRP; the default tolerance is one decimal's rounding."""
    return _identity_check(
        products, "gross_margin_pct", ratio(F.col("mrp") - F.col("cost_price"), "mrp") * 100.0, tolerance
    )


def roas_identity_check(marketing: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Stored ROAS against attributed revenue / spend."""
    return _identity_check(marketing, "roas", ratio("attributed_revenue_lakhs", "spend_inr_lakhs"), tolerance)


def key_uniqueness_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key values that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)


def wide_key_check(df: DataFrame, keys: Sequence[str], digest: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """``key_uniqueness_check`` for keys of long texts or many columns, whose values are not worth shuffling.

    Only 64-bit hashes are shuffled to be counted; rows whose hash occurs twice are counted by their full keys, so a
    collision of hashes is no duplicate. ``df`` is read twice; ``digest`` is never NULL.
    """
    hashed = df.select(*keys, digest(*keys).alias("digest"))
    twice = hashed.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("digest")
    return key_uniqueness_check(hashed.join(twice, "digest", "left_semi"), keys)
