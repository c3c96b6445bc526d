"""Fill missing periods in proportion to areas that are surveyed every period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gapweave.functions.aggregates import sum0
from gapweave.functions.scalars import cv, var_from_cv
from gapweave.operators.blocks import (
    BLOCK,
    add_block,
    blocks_in_order,
    earlier,
    everything,
    neighbour,
    whole_block,
    with_context,
    within_block,
)
from gapweave.operators.grid import RUN, Context, as_runs, grid_blocks, observed_times
from gapweave.spec import PANEL, PanelSpec


def ratio_runs(df: DataFrame, spec: PanelSpec, targets, references: Sequence) -> DataFrame:
    """Grid times per key and block, each with the references and their values before.

    Reference ``i`` is in ``ref<i>``, its last known value before that time in ``prev<i>``.
    """
    area = F.col(spec.area)

    def at_time(reference) -> Column:
        if isinstance(reference, str):
            member = area == reference
            value = lambda m: F.max(F.when(member, F.col(m)))
        else:
            member = ~area.isin(*targets) if reference is None else area.isin(*reference)
            value = lambda m: sum0(F.when(member, F.col(m)))
        # One reference per time, missing where no member area has a row.
        return F.when(F.count(F.when(member, 1)) > 0, F.struct(*(value(m).alias(m) for m in spec.measures)))

    numbers = range(len(references))
    times = observed_times(df, spec, None, *(at_time(r).alias(f"ref{i}") for i, r in enumerate(references)))
    before = earlier(within_block(spec.keys, spec.time))
    prevs = {f"prev{i}": F.last(f"ref{i}", ignorenulls=True).over(before) for i in numbers}
    runs = as_runs(times.withColumns(prevs), spec)
    if spec.one_block:
        start = lambda x, i: x[f"ref{i}"]
    else:

        def last(i: int) -> Column:
            known = F.filter(RUN, lambda x: x[f"ref{i}"].isNotNull())
            return F.try_element_at(known, F.lit(-1))[f"ref{i}"]

        # Only the last references are gathered per key, not the runs.
        over = earlier(blocks_in_order(spec.keys))
        carried = [F.last(f"_last{i}", ignorenulls=True).over(over).alias(f"_carried{i}") for i in numbers]
        table = runs.select(*spec.keys, BLOCK, *(last(i).alias(f"_last{i}") for i in numbers))
        runs = runs.join(table.select(*spec.keys, BLOCK, *carried), [*spec.keys, BLOCK])
        start = lambda x, i: F.coalesce(F.col(f"_carried{i}"), x[f"ref{i}"])

    def moment(x):
        # The first reference of all is compared with itself.
        prev = lambda i: F.when(x[f"ref{i}"].isNotNull(), F.coalesce(x[f"prev{i}"], start(x, i)))
        both = [c for i in numbers for c in (x[f"ref{i}"].alias(f"ref{i}"), prev(i).alias(f"prev{i}"))]
        return F.struct(x[spec.time].alias(spec.time), *both)

    return runs.select(*spec.keys, BLOCK, F.transform(RUN, moment).alias(RUN))


def reference_ratio(
    df: DataFrame,
    spec: PanelSpec = PANEL,
    *,
    targets: Sequence[str],
    reference: str | Sequence[str] | None = None,
) -> DataFrame:
    """Per key and time, change of the reference since the time before.

    ``reference`` is one area (its value as it is), several areas, or ``None`` for
    all areas but the targets (the sum of what is known, 0 if nothing is). Gives
    ``<measure>_ref``, ``<measure>_ref_prev`` and ``<measure>_ratio`` for every
    observed time; times without a reference row have NULL and are stepped over by
    the next one. The first reference is compared with itself.
    """
    runs = ratio_runs(df, spec, targets, [reference])
    out = runs.select(*spec.keys, F.inline(RUN))
    return out.select(
        *spec.keys,
        spec.time,
        *(
            c
            for m in spec.measures
            for c in (
                F.col("ref0")[m].alias(f"{m}_ref"),
                F.col("prev0")[m].alias(f"{m}_ref_prev"),
                F.try_divide(F.col("ref0")[m], F.col("prev0")[m]).alias(f"{m}_ratio"),
            )
        ),
    )


def mean_cv_context(spec: PanelSpec) -> Context:
    m = spec.measures[0]
    one = cv(m, spec.var(m))
    total = lambda c, keys: F.sum(c).over(everything(blocks_in_order(keys)))
    return Context(
        [F.sum(one).alias("_cv_sum"), F.count(one).alias("_cv_n")],
        {"_cv_sum": F.col("_cv_sum"), "_cv_n": F.col("_cv_n")},
        lambda keys: {"_mean_cv": F.try_divide(total("_cv_sum", keys), total("_cv_n", keys))},
    )


def lag_context(spec: PanelSpec) -> Context:
    time, measures = F.col(spec.time), spec.measures
    # The row before a block is the last grid cell of the block before, observed or not.
    observed = F.col("_last_t") == F.element_at(RUN, -1)[spec.time]
    edge = F.struct(*(F.when(observed, F.col(f"_last_{m}")).alias(m) for m in measures))
    return Context(
        [F.max(time).alias("_last_t"), *(F.max_by(m, time).alias(f"_last_{m}") for m in measures)],
        {"_last_cell": edge},
        lambda keys: {"_edge": F.lag("_last_cell", 1).over(blocks_in_order(keys))},
    )


def with_mean_cv(rows: DataFrame, spec: PanelSpec, start: int, early_cv: float) -> DataFrame:
    """Mean CV of the first measure over all times of a series, on every row of it."""
    m = spec.measures[0]
    mean = F.col("_mean_cv")
    if spec.one_block:
        mean = F.avg(cv(m, spec.var(m))).over(whole_block(spec.series, spec.time))
    modern = F.col(spec.time) >= start
    value = F.when(modern, F.coalesce(mean, F.lit(0.0))).otherwise(F.lit(early_cv))
    return rows.withColumn("mean_cv", value).drop("_mean_cv")


def lag_first_default(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Completed grid with ``<measure>_lag``, the value in the row before.

    The first row of a series sees itself; a missing value before stays missing.
    """
    rows = grid_blocks(df, spec, contexts=[lag_context(spec)])
    return with_lags(rows, spec).select(*spec.cell, *spec.values, *(f"{m}_lag" for m in spec.measures))


def with_lags(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    edge = None if spec.one_block else "_edge"
    rows = neighbour(rows, spec.series, spec.time, spec.measures, -1, edge)
    lag = lambda m: F.when(F.col("_adjacent").isNull(), F.col(m)).otherwise(F.col("_adjacent")[m])
    return rows.withColumns({f"{m}_lag": lag(m) for m in spec.measures}).drop("_adjacent", "_edge")


def assigned_variance(
    spec: PanelSpec, targets, start: int, end: int | None, values: dict[str, Column] | None = None
) -> dict[str, Column]:
    values = values or {m: F.col(m) for m in spec.measures}
    time = F.col(spec.time)
    inside = F.col(spec.area).isin(*targets) & (time >= start)
    if end is not None:
        inside = inside & (time <= end)
    return {
        spec.var(m): F.when(
            inside & values[m].isNotNull() & F.col(spec.var(m)).isNull(), var_from_cv("mean_cv", values[m])
        ).otherwise(F.col(spec.var(m)))
        for m in spec.measures
    }


def filled_by_ratio(spec: PanelSpec, targets, ratio) -> dict[str, Column]:
    """Each measure, in gaps of the targets the row before times ``ratio(measure)``."""
    gap = F.col(spec.area).isin(*targets)
    return {
        m: F.when(gap & F.col(m).isNull(), F.col(f"{m}_lag") * ratio(m)).otherwise(F.col(m))
        for m in spec.measures
    }


def assign_mean_cv_variance(
    df: DataFrame,
    spec: PanelSpec = PANEL,
    *,
    targets: Sequence[str],
    start: int,
    end: int | None = None,
    early_cv: float = 0.05,
) -> DataFrame:
    """Give valued cells of the target areas that lack a variance one from the mean CV.

    The mean CV is that of the first measure over all times of the series and
    serves every measure; before ``start`` it is ``early_cv``, and 0 where
    undefined. Without ``end`` the last time of the input is the upper limit, which
    no row exceeds. Adds the column ``mean_cv``.
    """
    rows = add_block(df, spec)
    if not spec.one_block:
        context = mean_cv_context(spec)
        rows = with_context(rows, spec.series, context.summaries, context.columns)
    rows = with_mean_cv(rows, spec, start, early_cv)
    return rows.withColumns(assigned_variance(spec, targets, start, end)).drop(BLOCK)


def fill_ratio(
    df: DataFrame,
    spec: PanelSpec = PANEL,
    *,
    targets: Sequence[str],
    reference: str | Sequence[str] | None = None,
    start: int,
    end: int | None = None,
    early_cv: float = 0.05,
    label: str = "ratio",
) -> DataFrame:
    """Fill gaps of the target areas by their last value times the reference's change.

    The last value is the *observed* one of the row before, so of two gaps in a row
    the second stays missing. Filled cells get a variance from the mean CV of their
    series. ``start`` drops earlier rows last: they still serve as the row before.
    """
    runs = ratio_runs(df, spec, targets, [reference])
    change = lambda x: F.struct(
        x[spec.time].alias(spec.time),
        *(F.try_divide(x["ref0"][m], x["prev0"][m]).alias(f"{m}_ratio") for m in spec.measures),
    )
    runs = runs.withColumn(RUN, F.transform(RUN, change))
    rows = grid_blocks(df, spec, runs=runs, contexts=[lag_context(spec), mean_cv_context(spec)])
    rows = with_mean_cv(with_lags(rows, spec), spec, start, early_cv)
    fills = filled_by_ratio(spec, targets, lambda m: F.col(f"{m}_ratio"))
    # The variances read the filled values, hence a second step.
    rows = rows.withColumns(fills).withColumns(assigned_variance(spec, targets, start, end))
    return rows.where(F.col(spec.time) >= start).select(
        *spec.cell, *spec.values, F.lit(label).alias("method")
    )
