"""Decimal types and arithmetic.

Money is exact decimal, so sums do not depend on task order, retries or partitioning.
Every product is cast to a stated type: engines differ in the precision they infer.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AMOUNT = T.DecimalType(18, 6)  # amounts as received
CENTS = T.DecimalType(18, 2)  # one rounded result
FINE = T.DecimalType(30, 10)  # unrounded intermediate
TOTAL = T.DecimalType(38, 2)  # sums of rounded results
RATE = T.DecimalType(9, 6)  # margins, fuel, VAT


def exact(value: Decimal | str) -> Column:
    return F.lit(Decimal(value))


def fine(c: Column) -> Column:
    return c.cast(FINE)


def cents(c: Column) -> Column:
    """Round half away from zero to two places."""
    return c.cast(CENTS)


def total(c: Column) -> Column:
    """Sum of a rounded column, as a plain two-place total."""
    return F.sum(c).cast(TOTAL)


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def plus(rate: Column | Decimal) -> Column:
    """1 + rate."""
    return F.lit(1) + (rate if isinstance(rate, Column) else exact(rate))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole with one decimal; NULL when the whole is zero."""
    ratio = F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.round(ratio.cast("decimal(28,9)"), 1)
