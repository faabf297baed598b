"""Additive states of measures: what a batch of order lines adds to any report.

A state is a sum, a count, a least value or a set; two states of the same group combine into one, in any order, and a
coarser grain is the combination of its finer groups. Means and shares are taken at the end.

Sets are bitmaps of 32,768 numbers each, so distinct orders and buyers add up as well: the union of
bitmaps instead of a sum of counts, which would count an order in two categories twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import ratio

#: Sums over lines: state -> column. Each mean needs the number of values beside the sum.
SUMS = {"units": "quantity", "revenue": "revenue_inr", "profit": "gross_profit_inr"}
MEANS = {"price": "selling_price", "discount": "discount_pct", "margin": "gross_margin_pct"}


def sales_states(lines: DataFrame, dims: Sequence[str]) -> DataFrame:
    """One row per group of ``dims``: lines, units, revenue, profit, and sum and number of price, discount and margin."""
    sums = [F.sum(column).alias(state) for state, column in SUMS.items()]
    means = [f(column).alias(state + end) for state, column in MEANS.items() for f, end in ((F.sum, "_sum"), (F.count, "_n"))]
    return lines.groupBy(*dims).agg(F.count(F.lit(1)).alias("lines"), *sums, *means)


def combined(states: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The states of the groups of ``dims``, a part of those that the states were made for; others are summed away."""
    names = ["lines", *SUMS, *(state + end for state in MEANS for end in ("_sum", "_n"))]
    return states.groupBy(*dims).agg(*[F.sum(name).alias(name) for name in names])


def mean(state: str) -> Column:
    """The mean of combined states; NULL without values."""
    return ratio(state + "_sum", state + "_n")


def distinct_states(rows: DataFrame, dims: Sequence[str], numbers: Mapping[str, str]) -> DataFrame:
    """Sets per group: (dims, kind, bucket, bitmap). ``numbers`` maps a kind ("orders") to a column of whole numbers.

    A NULL is in no set, as in COUNT(DISTINCT). The numbers should be dense (``plans.ranking.dense_numbers``), and
    near to each other within a group: a bitmap takes 4 KB however few numbers are in it. So tasks send the numbers they
    have, two bytes each and each once, and a bitmap is made where all numbers of its bucket are.
    """
    kinds = list(numbers)

    def place(number: int) -> Column:
        value = F.col(numbers[kinds[number]]).cast("bigint")
        return F.struct(
            F.lit(number).alias("kind"), F.bitmap_bucket_number(value).alias("bucket"), F.bitmap_bit_position(value).cast("smallint").alias("position")
        )

    each = rows.select(*dims, F.inline(F.array(*[place(number) for number in range(len(kinds))]))).filter("position IS NOT NULL")
    keys = [*dims, "kind", "bucket"]
    sets = each.groupBy(*keys).agg(F.collect_set("position").alias("positions"))
    bitmaps = sets.select(*keys, F.explode("positions").alias("position")).groupBy(*keys).agg(
        F.bitmap_construct_agg(F.col("position").cast("bigint")).alias("bitmap")
    )
    return bitmaps.withColumn("kind", F.element_at(F.array(*[F.lit(kind) for kind in kinds]), F.col("kind") + 1))


def united(states: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The sets of the groups of ``dims``, unions over all others."""
    return states.groupBy(*dims, "kind", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def distinct_counts(states: DataFrame, dims: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """The exact number of distinct values per group of ``dims``, a column for each of ``kinds``."""
    sizes = united(states, dims).withColumn("size", F.bitmap_count("bitmap"))
    return sizes.groupBy(*dims).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("size"))), F.lit(0)).alias(k) for k in kinds])
