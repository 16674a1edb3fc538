"""Small numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stdev0(x: Column) -> Column:
    """sample standard deviation (N-1); one value -> 0; none -> NULL."""
    n = F.count(x)
    return F.when(n == 1, F.lit(0.0)).when(n > 1, F.stddev_samp(x))


def safe_div(a: Column, b: Column) -> Column:
    """Division that gives NULL for a zero divisor (ANSI mode is on)."""
    return F.try_divide(a, b)


def nan_to_null(x: Column) -> Column:
    """NaN marks a missing value in the reference; SQL uses NULL."""
    return F.nanvl(x, F.lit(None).cast("double"))


def round6(x: Column) -> Column:
    return F.round(x, 6)
