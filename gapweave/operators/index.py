"""Total indices over areas, with limits, and their reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gapweave.functions.aggregates import strict_sum, sum0
from gapweave.functions.intervals import normal_limits
from gapweave.functions.scalars import var_from_cv
from gapweave.spec import PANEL, PanelSpec


def total_index(stacked: DataFrame, spec: PanelSpec = PANEL, group: Sequence[str] = ("method",)) -> DataFrame:
    """Sum over areas per key, group and time; missing if any area is missing."""
    return stacked.groupBy(*spec.keys, *group, spec.time).agg(
        *(strict_sum(m).alias(m) for m in spec.measures)
    )


def index_with_ci(
    stacked: DataFrame,
    spec: PanelSpec = PANEL,
    *,
    measure: str | None = None,
    fallback_cv: float = 0.2,
    z: float = 1.96,
    scale: float = 1.0,
    group: Sequence[str] = ("method",),
) -> DataFrame:
    """Sum values and variances over areas, with normal limits.

    A total variance that is missing or zero is replaced by that of ``fallback_cv``.
    ``scale`` divides value and limits for reporting, not the variance.
    """
    m = measure or spec.measures[0]
    v = spec.var(m)
    out = stacked.groupBy(*spec.keys, *group, spec.time).agg(sum0(m).alias(m), sum0(v).alias(v))
    out = out.withColumn(v, F.when(F.col(v) == 0, var_from_cv(fallback_cv, m)).otherwise(F.col(v)))
    low, upp = normal_limits(m, v, z)
    out = out.withColumns({"lci": low, "uci": upp})
    if scale == 1.0:
        return out
    return out.withColumns({c: F.col(c) / F.lit(float(scale)) for c in (m, "lci", "uci")})


def reconcile(total: DataFrame, published: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Computed beside published totals, with the relative difference per measure."""
    known = published.select(
        *spec.keys, spec.time, *(F.col(m).alias(f"{m}_published") for m in spec.measures)
    )
    out = total.join(known, [*spec.keys, spec.time], "full")
    return out.withColumns(
        {
            f"{m}_rel_diff": F.try_divide(F.col(m) - F.col(f"{m}_published"), F.col(f"{m}_published"))
            for m in spec.measures
        }
    )
