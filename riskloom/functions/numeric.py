"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator where the denominator is positive, else 0."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


# Amounts are added up to the hundredth of a cent.
AMOUNT = "decimal(28,4)"


def money_total(amount: Column) -> Column:
    """Sum of dollar amounts as decimals, then a double.

    Decimal sums do not depend on the order partitions arrive in and stay exact for a
    key that holds trillions of rows. An amount that does not fit stops the job.
    """
    return F.sum(amount.cast(AMOUNT)).cast("double")
