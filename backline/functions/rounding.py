"""Rounding rules.  Each operator names the one its formula was defined with."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_even(c: Column, digits: int = 0) -> Column:
    """Ties to even on the scaled double (Python / numpy rule)."""
    if digits == 0:
        return F.rint(c)
    scale = F.lit(float(10**digits))
    return F.rint(c * scale) / scale


def half_up(c: Column, digits: int = 0) -> Column:
    """Ties toward +infinity (ECMAScript ``Math.round`` on the scaled double)."""
    if digits == 0:
        return F.floor(c + F.lit(0.5)).cast("double")
    scale = F.lit(float(10**digits))
    return F.floor(c * scale + F.lit(0.5)).cast("double") / scale


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def cents_sum(c: Column) -> Column:
    """Order-independent sum of a money column: exact decimal, given back as double."""
    return F.sum(c.cast("decimal(24,4)")).cast("double")


def cents_mean(c: Column) -> Column:
    """Mean of a money column from the exact sum; null when there is no value."""
    return F.try_divide(cents_sum(c), F.count(c).cast("double"))
