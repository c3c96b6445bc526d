"""Stack filled panels of several methods, mark survey values and score methods."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapweave.functions.scalars import percent_difference
from gapweave.operators.blocks import next_row
from gapweave.spec import PANEL, PanelSpec, Schedule


def category_order(column: str, levels: Sequence[str]) -> Column:
    """Position of a label in a given order, 1 for the first; unknown labels NULL."""
    found = F.array_position(F.array(*(F.lit(x) for x in levels)), F.col(column))
    return F.nullif(found, F.lit(0)).cast("int")


def union_panels(panels: Sequence[DataFrame]) -> DataFrame:
    """Stack by column name; columns that one input lacks become missing there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), panels)


def stack_methods(
    panels: Sequence[DataFrame],
    spec: PanelSpec = PANEL,
    *,
    schedule: Schedule,
    areas: Sequence[str] | None = None,
    methods: Sequence[str] | None = None,
) -> DataFrame:
    """Stack filled panels and add ``obs_<measure>``, the value if it is a survey's.

    What counts as surveyed follows from the schedule, not from which values were
    missing. ``areas`` and ``methods`` give the category orders of ``area_order``
    and ``method_order``.
    """
    out = union_panels(panels)
    surveyed = schedule.surveyed(spec.area, spec.time)
    out = out.withColumns({f"obs_{m}": F.when(surveyed, F.col(m)) for m in spec.measures})
    if areas is not None:
        out = out.withColumn("area_order", category_order(spec.area, areas))
    if methods is not None:
        out = out.withColumn("method_order", category_order("method", methods))
    return out


def step_ahead(
    stacked: DataFrame, spec: PanelSpec, pairs: dict[str, tuple[str, str]], keys: Sequence[str]
) -> DataFrame:
    """Percent difference between each estimate and the next observation.

    ``pairs`` maps an output column to ``(estimate, observation)`` columns.
    """
    seen = {obs: f"_next_{obs}" for _, obs in pairs.values()}
    rows = next_row(stacked, keys, spec, {new: obs for obs, new in seen.items()})
    return rows.withColumns(
        {out: percent_difference(seen[obs], est) for out, (est, obs) in pairs.items()}
    ).drop(*seen.values())


def score_methods(
    stacked: DataFrame, spec: PanelSpec = PANEL, *, targets: Sequence[str], ranked: bool = False
) -> DataFrame:
    """Mean percent difference of each method to the next observation, per area.

    Rows without a next observation do not count. ``ranked`` adds ``score_rank``.
    """
    rows = stacked.where(F.col(spec.area).isin(*targets))
    rows = rows.select(
        *spec.cell, "method", *(c for m in spec.measures for c in (m, f"obs_{m}"))
    )
    pairs = {f"{m}_pdiff": (m, f"obs_{m}") for m in spec.measures}
    rows = step_ahead(rows, spec, pairs, [*spec.series, "method"])
    out = rows.groupBy(*spec.series, "method").agg(
        *(F.avg(f"{m}_pdiff").alias(f"{m}_stat") for m in spec.measures)
    )
    if ranked:
        first = f"{spec.measures[0]}_stat"
        order = Window.partitionBy(*spec.series).orderBy(F.asc_nulls_last(first))
        out = out.withColumn("score_rank", F.rank().over(order))
    return out


def score_predictions(
    table: DataFrame, spec: PanelSpec = PANEL, *, measure: str | None = None
) -> DataFrame:
    """Mean percent difference of each *prediction*, not the filled value, to the next observation.

    ``table`` has the measure and ``<measure>_pred`` per cell, as from ``obs_pred_table``. A
    row whose next cell is missing does not count. Gives ``pred_stat`` per series.
    """
    m = measure or spec.measures[0]
    rows = table.select(*spec.cell, m, f"{m}_pred")
    rows = step_ahead(rows, spec, {"pdiff": (f"{m}_pred", m)}, spec.series)
    return rows.groupBy(*spec.series).agg(F.avg("pdiff").alias("pred_stat"))


def compare_external(
    observed: DataFrame,
    external: DataFrame,
    new: DataFrame,
    spec: PanelSpec = PANEL,
    *,
    measure: str | None = None,
    exclude: Sequence[str] = (),
    relabel: tuple[str, str, str] | None = None,
    label: str = "new",
) -> DataFrame:
    """Score results of other methods beside a new one against the same observations.

    ``observed`` has ``obs`` per cell, ``external`` the measure and ``method`` per
    cell, ``new`` the measure per cell. ``relabel=(x, a, b)`` names method ``x`` a
    and all others b, whose scores are averaged together. Observations without an external result stay, as in a left
    join. Gives the mean percent difference per key, area and method.
    """
    name = measure or spec.measures[0]
    other = external.select(*spec.cell, F.col(name).alias("estimate"), "method")
    if exclude:
        other = other.where(~F.col("method").isin(*exclude))
    obs = observed.select(*spec.cell, "obs")
    joined = obs.join(other, spec.cell, "left")
    # The next observation is looked up per method as it was named, before labels fold.
    # A time that no method covers is a group of its own, whose label is NULL.
    joined = joined.withColumn("_of", F.coalesce(F.concat(F.lit("="), "method"), F.lit("")))
    if relabel is not None:
        which, a, b = relabel
        # A missing method stays missing.
        method = F.when(F.col("method") == which, a).when(F.col("method").isNotNull(), b)
        joined = joined.withColumn("method", method)
    mine = obs.join(new.select(*spec.cell, F.col(name).alias("estimate")), spec.cell, "left")
    both = joined.unionByName(mine.withColumns({"method": F.lit(label), "_of": F.lit("+")}))
    rows = step_ahead(both, spec, {"pdiff": ("estimate", "obs")}, [*spec.series, "_of"])
    return rows.groupBy(*spec.series, "method").agg(F.avg("pdiff").alias("mean_pdiff"))
