"""Rounding, ratios and money units as Column expressions.

All of them are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUPEES_PER_LAKH = 1e5
RUPEES_PER_THOUSAND = 1e3


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x: Column | str, n: int) -> Column:
    """Round half away from zero at ``n`` decimals, as a double.

    A double that should be a decimal tie (130.765) is stored a hair above or below it, and the
    hair depends on the order in which partitions were summed. Passing through a decimal with
    eight places removes the hair first, so a result does not change from run to run.
    """
    return F.round(as_col(x).cast("decimal(28,8)"), n).cast("double")


def rnd_all(df, n: int):
    """``rnd`` on every double column of ``df``; the other columns pass through."""
    return df.select(
        *[rnd(F.col(f"`{c}`"), n).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as a double, NULL where the denominator is zero (ANSI mode would raise)."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def pct(num: Column | str, den: Column | str, n: int = 1) -> Column:
    return rnd(ratio(num, den) * 100.0, n)


def growth_pct(new: Column | str, old: Column | str, n: int = 1) -> Column:
    return pct(as_col(new) - as_col(old), old, n)


def lakhs(x: Column | str, n: int = 2) -> Column:
    return rnd(as_col(x) / RUPEES_PER_LAKH, n)


def case(*rules: tuple[Column, object], default: object = None) -> Column:
    """Searched CASE: the value of the first rule that holds, else ``default``."""
    (cond, value), *rest = rules
    column = F.when(cond, value)
    for cond, value in rest:
        column = column.when(cond, value)
    return column.otherwise(default)


def count_where(cond: Column) -> Column:
    """Rows where ``cond`` holds; NULL counts as not holding, an empty group gives 0."""
    return F.count(F.when(cond, F.lit(1)))


def first_largest(value: Column | str, name: str) -> Column:
    """Aggregate: the ``name`` with the largest ``value``, the alphabetically first one on a tie.

    One struct per group is kept, so it combines map-side; ``max_by`` alone leaves ties open.
    """
    value = as_col(value)
    key = F.struct((-value).alias("neg"), F.col(name).alias("name"))
    return F.min(F.when(value.isNotNull(), key))["name"]


def first_smallest(value: Column | str, name: str) -> Column:
    value = as_col(value)
    key = F.struct(value.alias("val"), F.col(name).alias("name"))
    return F.min(F.when(value.isNotNull(), key))["name"]
