"""Aggregates whose treatment of missing values differs from SQL's."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gapweave.functions.scalars import as_col


def sum0(x) -> Column:
    """Sum that ignores missing values and is 0 when all are missing."""
    return F.coalesce(F.sum(as_col(x)), F.lit(0.0))


def strict_sum(x) -> Column:
    """Sum that is missing as soon as one input is missing."""
    x = as_col(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def total_of_distinct(a, b) -> Column:
    """Sum of the distinct non-missing values among two (equal values count once)."""
    a, b = as_col(a), as_col(b)
    both = F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
    return F.when(a == b, a).otherwise(both)
