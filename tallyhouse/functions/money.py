"""Money arithmetic: exact decimal sums, one division at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def line_total(price: Column, quantity: Column) -> Column:
    """price x quantity, wide enough for any int quantity; null where either is null."""
    return (price * quantity).cast("decimal(20,2)")


def total_or_zero(amount: Column) -> Column:
    return F.coalesce(F.sum(amount), F.lit(0))


def mean(amount: Column) -> Column:
    """Average as double, taken from the exact sum: the same on every partitioning of the rows."""
    return F.try_divide(F.sum(amount).cast("double"), F.count(amount).cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """part / whole rounded half-up to 4 places, as a percentage; 0 where whole is 0 or either is null."""
    ratio = F.round(part.cast("decimal(20,2)") / F.nullif(whole.cast("decimal(20,2)"), F.lit(0)), 4)
    return F.coalesce((ratio * 100).cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)"))
