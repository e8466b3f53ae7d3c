"""Exact money arithmetic.

Amounts are stored as doubles. A sum of doubles depends on the order in which tasks deliver
their parts, so amounts are summed as whole ticks of 1/10000, exact for amounts of up to four
decimals. A total is kept as two longs per group, of the high and of the low bits: together
they hold more than a long, and are far cheaper than a decimal sum.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F, types as T

# What an amount must fit to be accepted at ingest.
MONEY = T.DecimalType(18, 4)
TICKS = 10_000

# Bits of the low part of a sum: rows by the million million do not overflow it.
LOW_BITS = 20


def ticks(column: str | Column) -> Column:
    """An amount, double or decimal, as a whole number of ticks."""
    amount = F.col(column) if isinstance(column, str) else column
    return F.rint(amount * TICKS).cast("long")


def summed(amount: Column) -> Column:
    """The sum of ticks as a whole decimal, also beyond what a long holds."""
    high = F.sum(F.shiftright(amount, LOW_BITS)).cast("decimal(19,0)")
    low = F.sum(amount.bitwiseAND(F.lit((1 << LOW_BITS) - 1))).cast("decimal(19,0)")
    return high * F.lit(Decimal(1 << LOW_BITS)) + low


def exact(total: Column) -> Column:
    """Summed ticks as a decimal amount."""
    return total.cast("decimal(29,0)") * F.lit(Decimal(1) / TICKS)


def as_double(total: Column) -> Column:
    """Summed ticks as a double amount."""
    return exact(total).cast("double")


def cents(total: Column) -> Column:
    """Summed ticks as a double amount, rounded to cents before it leaves the decimal."""
    return F.round(exact(total), 2).cast("double")


def mean(total: Column, count: Column) -> Column:
    """Summed ticks by count; null where there is nothing to count."""
    return F.try_divide(as_double(total), count.cast("double"))


def percentage(part: Column, whole: Column) -> Column:
    """Part of whole in percent, 0 where the whole is 0."""
    share = F.try_divide(part.cast("double") * 100, whole.cast("double"))
    return F.coalesce(share, F.lit(0.0))


def percent_change(new: Column, old: Column) -> Column:
    """Change from old to new in percent: 0 where old is not positive, null where unknown."""
    return F.when(old > 0, F.try_divide(new - old, old) * 100).when(
        new.isNotNull() & old.isNotNull(), F.lit(0.0)
    )


def clamp(column: Column, low, high) -> Column:
    return F.least(F.greatest(column, low), high)
