"""Interval expressions on the identity, log and logit scales."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, functions as F

from gapweave.functions.scalars import as_col, geninvlogit


def z_value(p: float = 0.975) -> float:
    """Standard normal quantile, evaluated once on the driver."""
    return NormalDist().inv_cdf(p)


def normal_limits(x, variance, z: float = 1.96) -> tuple[Column, Column]:
    half = z * F.sqrt(as_col(variance))
    return as_col(x) - half, as_col(x) + half


def lognormal_limits(log_x, log_sd, p: float = 0.975) -> tuple[Column, Column]:
    half = z_value(p) * as_col(log_sd)
    return F.exp(as_col(log_x) - half), F.exp(as_col(log_x) + half)


def ci(
    par,
    se,
    p: float = 0.975,
    lo: float = 0.0,
    hi: float = 1.0,
    type: str = "I",
    k: float = 1.0,
) -> Column:
    """Struct ``(est, se, lci, uci)`` of a parameter known on a transformed scale.

    ``type`` is ``"I"`` (identity), ``"exp"`` or ``"expit"``. In the last form ``k``
    enters the delta-method standard error only; point and limits use slope 1.
    """
    par, se = as_col(par), as_col(se)
    half = z_value(p) * se
    low, upp = par - half, par + half
    if type == "I":
        out = par, se, low, upp
    elif type == "exp":
        out = F.exp(par), F.exp(par) * se, F.exp(low), F.exp(upp)
    elif type == "expit":
        q = 1.0 / (1.0 + F.exp(-float(k) * par))
        width = float(hi) - float(lo)
        out = (
            geninvlogit(par, lo, hi),
            float(k) * abs(width) * q * (1.0 - q) * se,
            float(lo) + width / (1.0 + F.exp(-low)),
            float(lo) + width / (1.0 + F.exp(-upp)),
        )
    else:
        raise ValueError(f"unknown interval type {type!r}")
    return F.struct(*(c.alias(n) for c, n in zip(out, ("est", "se", "lci", "uci"))))
