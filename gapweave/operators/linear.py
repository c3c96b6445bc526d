"""Fill missing periods by linear interpolation of value and CV."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gapweave.functions.scalars import cv, var_from_cv
from gapweave.operators.grid import grid_blocks, grid_lists
from gapweave.operators.interpolate import abscissa, interpolate_blocks, interpolation_context
from gapweave.operators.interpolate_batches import interpolate_lists
from gapweave.spec import PANEL, PanelSpec


def cv_table(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Replace each variance column by the coefficient of variation."""
    out = df.withColumns({spec.cv(m): cv(m, spec.var(m)) for m in spec.measures})
    return out.drop(*(spec.var(m) for m in spec.measures))


def fill_linear(
    df: DataFrame,
    spec: PanelSpec = PANEL,
    *,
    start: int | None = None,
    maxgap: int = 20,
    by: str = "position",
    label: str = "linear",
    keep_cv: bool = False,
) -> DataFrame:
    """Fill each area by interpolating its values and CVs; ends carry the nearest.

    ``start`` drops earlier rows *before* interpolation, so they have no influence.
    A variance is derived from the interpolated value and CV only where missing.
    """
    cvs = {spec.cv(m): cv(m, spec.var(m)) for m in spec.measures}
    columns, x = [c for m in spec.measures for c in (m, spec.cv(m))], abscissa(by, spec)
    context = interpolation_context(columns, spec, x)
    if spec.one_block or spec.buckets:
        rows = grid_blocks(df.withColumns(cvs), spec, start=start, contexts=[context])
        rows = interpolate_blocks(rows, spec.series, spec, columns, x=x, maxgap=maxgap)
    else:
        values = [*columns, *(spec.var(m) for m in spec.measures)]
        lists = df.withColumns(cvs).select(*spec.cell, *(F.col(c).cast("double").alias(c) for c in values))
        lists = grid_lists(lists, spec, start=start, contexts=[context])
        rows = interpolate_lists(lists, spec, columns, values, x=x, maxgap=maxgap)
    rows = rows.withColumns(
        {spec.var(m): F.coalesce(F.col(spec.var(m)), var_from_cv(spec.cv(m), m)) for m in spec.measures}
    )
    kept = [spec.cv(m) for m in spec.measures] if keep_cv else []
    return rows.select(*spec.cell, *spec.values, *kept, F.lit(label).alias("method"))
