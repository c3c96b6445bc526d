"""End-to-end flows: compare filling methods, and build a total index."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gapweave.operators.ar1 import fill_ar1
from gapweave.operators.index import index_with_ci, total_index
from gapweave.operators.linear import fill_linear
from gapweave.operators.several import fill_several
from gapweave.operators.share import fill_ltmean
from gapweave.operators.stack import score_methods, stack_methods, union_panels
from gapweave.spec import PANEL, PanelSpec, Schedule
from gapweave.storage import materialize


@dataclass(frozen=True)
class Comparison:
    stacked: DataFrame
    scores: DataFrame
    totals: DataFrame


def compare_methods(
    panel: DataFrame,
    spec: PanelSpec = PANEL,
    *,
    targets: Sequence[str],
    neighbour: str,
    schedule: Schedule,
    start: int,
    areas: Sequence[str] | None = None,
    ar1_options: dict | None = None,
) -> Comparison:
    """Fill by four methods, score them against the next observation and add areas up.

    The panel should be a stored table, which is read several times: ratios and interpolation
    share one grid, the AR(1) model has its own. The stack is written
    once, as scores and totals both read it.
    """
    filled = [
        fill_several(
            panel,
            spec,
            targets=targets,
            references={"total_ratio": None, "neighbour_ratio": neighbour},
            start=start,
        ),
        fill_ar1(panel, spec, targets=targets, start=start, label="ar1", **(ar1_options or {})),
    ]
    methods = ["total_ratio", "neighbour_ratio", "linear", "ar1"]
    stacked = materialize(
        stack_methods(filled, spec, schedule=schedule, areas=areas, methods=methods)
    )
    return Comparison(stacked, score_methods(stacked, spec, targets=targets), total_index(stacked, spec))


def share_and_linear_index(
    panel: DataFrame,
    spec: PanelSpec = PANEL,
    *,
    pair: tuple[str, str],
    mean_start: int,
    start: int,
    older: DataFrame | None = None,
    fallback_cv: float = 0.2,
    scale: float = 1.0,
) -> DataFrame:
    """Index of a pair of areas by long-term shares and by linear filling, with limits.

    ``older`` is an earlier version of the panel, whose shares give a third method.
    """
    measure = spec.measures[0]
    shares = {"ltmean": panel} if older is None else {"ltmean_older": older, "ltmean": panel}
    filled = [
        fill_ltmean(p, spec, pair=pair, measure=measure, mean_start=mean_start, start=start, label=name)
        for name, p in shares.items()
    ]
    both = panel.where(F.col(spec.area).isin(*pair))
    filled.append(fill_linear(both, spec, start=start, label="linear"))
    return index_with_ci(
        union_panels(filled), spec, measure=measure, fallback_cv=fallback_cv, scale=scale
    )
