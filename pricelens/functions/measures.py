"""Aggregate expressions over the pricing fact, used under many grains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens.functions.numeric import ratio, sum_if

col = F.col


def revenue() -> Column:
    return F.sum("line_revenue")


def list_revenue() -> Column:
    return F.sum("line_list_revenue")


def margin_value() -> Column:
    return F.sum("gross_margin_value")


def avg_discount() -> Column:
    return F.avg("discount_depth")


def high_share() -> Column:
    return F.avg("high_discount_flag")


def high_revenue() -> Column:
    return sum_if(col("high_discount_flag") == 1, col("line_revenue"))


def lines() -> Column:
    return F.count(F.lit(1))


def realization(otherwise: float | None = None) -> Column:
    return ratio(revenue(), list_revenue(), otherwise)


def weighted_discount(otherwise: float | None = None) -> Column:
    """One minus net over list: the discount weighted by list value."""
    return ratio(list_revenue() - revenue(), list_revenue(), otherwise)


def margin_pct(otherwise: float | None = None) -> Column:
    return ratio(margin_value(), revenue(), otherwise)


def high_revenue_share(otherwise: float | None = None) -> Column:
    return ratio(high_revenue(), revenue(), otherwise)
