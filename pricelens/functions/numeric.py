"""Numeric column helpers that stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, otherwise: float | None = None) -> Column:
    """``numerator / denominator`` where the denominator is positive, else ``otherwise``."""
    guarded = F.when(denominator > 0, numerator / denominator)
    return guarded if otherwise is None else guarded.otherwise(F.lit(otherwise))


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp to ``[low, high]``; NULL stays NULL."""
    bounded = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    return F.when(value.isNotNull(), bounded)


def half_even(value: Column, digits: int) -> Column:
    """Round a double to ``digits`` places, ties to even, by scaling and ``rint``.

    Adding 0.0 turns a negative zero into zero, so both count as one value.
    """
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def on_grid(value: Column, bits: int) -> Column:
    """Round a double to a multiple of ``2 ** -bits``.

    Sums that differ only by the order of their terms become one value. Unlike decimal
    rounding it makes no decimal ties, which later rounding would break by chance.
    """
    scale = float(2**bits)
    return F.rint(value * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def count_if(condition: Column) -> Column:
    """Aggregate: rows on which the condition holds (0, not NULL, on no rows)."""
    return F.count(F.when(condition, F.lit(1)))


def sum_if(condition: Column, value: Column) -> Column:
    """Aggregate: sum of ``value`` where the condition holds, other rows as 0."""
    return F.sum(F.when(condition, value).otherwise(F.lit(0.0)))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: weighted mean; NULL when a value is unknown or no weight is above zero.

    A value without a number cannot be left out: its weight would stay in the denominator.
    """
    total = F.sum(weight)
    complete = F.count(F.when(value.isNull(), F.lit(1))) == 0
    return F.when((total > 0) & complete, F.sum(value * weight) / total)


def linear_step(value: Column, low: Column, high: Column, cells: int) -> Column:
    """Index of the equal-width cell of ``[low, high]`` that holds ``value``.

    Cells are closed below and open above, the last one closed on both sides. The two
    corrections move values that division put on the wrong side of their cell edge.
    """
    width = (high - low) / F.lit(float(cells))
    guess = F.least(F.floor((value - low) / width), F.lit(cells - 1))
    below = value < low + guess * width
    above = (value >= low + (guess + 1) * width) & (guess < cells - 1)
    cell = guess - below.cast("long") + above.cast("long")
    return F.when(high > low, cell).otherwise(F.when(value.isNotNull(), F.lit(0))).cast("long")
