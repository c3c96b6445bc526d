"""Several filling methods as columns of one completed grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gapweave.functions.scalars import cv, var_from_cv
from gapweave.operators.grid import RUN, grid_blocks
from gapweave.operators.interpolate import abscissa, interpolate_blocks, interpolation_context
from gapweave.operators.ratio import (
    assigned_variance,
    filled_by_ratio,
    lag_context,
    mean_cv_context,
    ratio_runs,
    with_lags,
    with_mean_cv,
)
from gapweave.spec import PANEL, PanelSpec


def fill_several(
    df: DataFrame,
    spec: PanelSpec = PANEL,
    *,
    targets: Sequence[str],
    references: dict[str, str | Sequence[str] | None],
    start: int,
    end: int | None = None,
    early_cv: float = 0.05,
    maxgap: int = 20,
    by: str = "position",
    linear: str = "linear",
) -> DataFrame:
    """The ratio fill by each of ``references`` and the linear fill, stacked.

    Gives the rows of :func:`fill_ratio` for every ``label: reference`` and those of
    :func:`fill_linear`, but builds and shuffles the grid once: each method is a set of
    columns on its rows, which become one row per method at the end. Rows before ``start``
    serve the ratios as the row before and have no influence on the interpolation.
    """
    early = F.col(spec.time) < start
    runs = ratio_runs(df, spec, targets, list(references.values()))
    ratio = lambda m, i: f"_{m}_ratio{i}"
    changes = lambda x: (
        F.try_divide(x[f"ref{i}"][m], x[f"prev{i}"][m]).alias(ratio(m, i))
        for i in range(len(references))
        for m in spec.measures
    )
    runs = runs.withColumn(RUN, F.transform(RUN, lambda x: F.struct(x[spec.time].alias(spec.time), *changes(x))))

    since = lambda c: f"_since_{c}"
    late = {since(m): F.when(~early, F.col(m)) for m in spec.measures}
    late |= {since(spec.cv(m)): F.when(~early, cv(m, spec.var(m))) for m in spec.measures}
    x = abscissa(by, spec)
    contexts = [lag_context(spec), mean_cv_context(spec), interpolation_context(list(late), spec, x, start)]
    rows = grid_blocks(df.select(*spec.cell, *spec.values).withColumns(late), spec, runs=runs, contexts=contexts)
    rows = with_mean_cv(with_lags(rows, spec), spec, start, early_cv)
    rows = interpolate_blocks(rows, spec.series, spec, list(late), x=x, maxgap=maxgap, start=start)

    def entry(label: str, values: dict, variances: dict):
        named = [c.alias(n) for m in spec.measures for n, c in ((m, values[m]), (spec.var(m), variances[spec.var(m)]))]
        return F.struct(*named, F.lit(label).alias("method"))

    entries = []
    for i, label in enumerate(references):
        values = filled_by_ratio(spec, targets, lambda m, i=i: F.col(ratio(m, i)))
        entries.append(entry(label, values, assigned_variance(spec, targets, start, end, values)))
    variances = {
        spec.var(m): F.coalesce(F.col(spec.var(m)), var_from_cv(since(spec.cv(m)), since(m))) for m in spec.measures
    }
    entries.append(entry(linear, {m: F.col(since(m)) for m in spec.measures}, variances))
    return rows.where(~early).select(*spec.cell, F.inline(F.array(*entries)))
