"""Scalar column functions. Division by zero gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def cv(x, variance) -> Column:
    """Coefficient of variation, ``sqrt(variance) / x``."""
    return F.try_divide(F.sqrt(as_col(variance)), as_col(x))


def var_from_cv(cv_, x) -> Column:
    """Variance of ``x`` with a given coefficient of variation, ``(cv * x)^2``."""
    sd = as_col(cv_) * as_col(x)
    return sd * sd


def log_positive(x) -> Column:
    """Natural log where ``x > 0``, else NULL."""
    return F.when(as_col(x) > 0, F.log(as_col(x)))


def log_var(cv_) -> Column:
    """Variance on the log scale of a log-normal value, ``log(cv^2 + 1)``."""
    c = as_col(cv_)
    return F.log(c * c + 1.0)


def log_sd(x, cv_) -> Column:
    """Log-scale standard deviation where ``x > 0``, else NULL."""
    return F.when(as_col(x) > 0, F.sqrt(log_var(cv_)))


def genlogit(x, low: float = 0.0, upp: float = 1.0) -> Column:
    """Logit of ``x`` scaled from ``(low, upp)``; NULL at or outside the limits."""
    p = (as_col(x) - F.lit(float(low))) / F.lit(float(upp) - float(low))
    return F.log(F.try_divide(p, 1.0 - p))


def geninvlogit(x, low: float = 0.0, upp: float = 1.0) -> Column:
    """Inverse of :func:`genlogit`, in the form that does not overflow."""
    return 1.0 / (1.0 + F.exp(-as_col(x))) * F.lit(float(upp) - float(low)) + F.lit(float(low))


def percent_difference(a, b) -> Column:
    """Symmetric percent difference, ``100 |a - b| / ((a + b) / 2)``."""
    a, b = as_col(a), as_col(b)
    return F.try_divide(100.0 * F.abs(a - b), (a + b) / 2.0)
