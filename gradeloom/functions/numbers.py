"""Aggregates over two-decimal scores whose result does not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_mean(value: Column, digits: int | None = None) -> Column:
    """Mean of two-decimal values, summed and divided as decimals, then rounded half up."""
    mean = F.try_divide(F.sum(value.cast("decimal(18,2)")), F.count(value))
    return (mean if digits is None else F.round(mean, digits)).cast("double")


def exact_median(value: Column) -> Column:
    """Exact median of two-decimal values, taken on whole hundredths."""
    return F.median(F.round(value * 100).cast("long")) / 100.0
