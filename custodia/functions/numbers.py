"""Guarded arithmetic shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(c: Column) -> Column:
    return c.cast("double")


def safe_ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """``num / den * scale`` as a double; null where the denominator is zero or null."""
    return F.try_divide(dbl(num), dbl(den)) * F.lit(float(scale))


def rounded(c: Column, digits: int) -> Column:
    """HALF_UP rounding of the decimal reading of a double, returned as a double."""
    return F.round(dbl(c), digits)


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(dbl(part) * F.lit(100.0), dbl(whole)), digits)


def count_true(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))
