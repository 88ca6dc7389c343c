"""Column tests for missing numbers.

A float is missing when it is not finite.  Spark sorts NaN above all numbers
and counts it, so every aggregate tests with ``finite`` first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def finite(value: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    value = value.cast("double")
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def or_nan(value: Column) -> Column:
    """Missing aggregates are NaN, as missing values are."""
    return F.coalesce(value, F.lit(NAN))


def describe(value: Column) -> list[Column]:
    """count, n_missing, min, max, mean and population std of the finite values."""
    good = F.when(finite(value), value)
    return [
        F.count(good).alias("count"),
        (F.count(F.lit(1)) - F.count(good)).alias("n_missing"),
        or_nan(F.min(good)).alias("min"),
        or_nan(F.max(good)).alias("max"),
        or_nan(F.avg(good)).alias("mean"),
        or_nan(F.stddev_pop(good)).alias("std"),
    ]


def seconds(timestamp: Column) -> Column:
    """A zoneless timestamp as seconds since 1970, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), timestamp.cast("timestamp_ntz")) / F.lit(1e6)
