"""Completion of a panel to a full grid, and long/wide reshaping."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gapweave.operators.blocks import (
    BLOCK,
    add_block,
    blocks_in_order,
    earlier,
    so_far,
    within_block,
)
from gapweave.spec import PANEL, PanelSpec

POS = "_pos"
RUN = "_run"
OFFSET = "_offset"
CONTEXT = "_context"
COUNT = "_count"
KNOWN = "_known"
STRIP = 1000  # rows of the smaller side of a product that meet a strip of the other side


@dataclass(frozen=True)
class Context:
    """What the rows of a block need to know about the other blocks of their series.

    ``summaries`` aggregate the data rows of one ``(series, block)``. ``block`` turns
    them into one small row per block; it may use ``_run`` (the grid times of the
    block) and ``_offset`` (how many grid times came before). ``columns`` derives the
    wanted columns from those rows by windows over the blocks of a series.
    """

    summaries: Sequence[Column]
    block: dict[str, Column]
    columns: Callable[[Sequence[str]], dict[str, Column]]


def single_rows(rows: DataFrame, key: Sequence[str], folds: dict[str, Column]) -> DataFrame:
    """Fold stacked rows per ``key``; a key with several counted rows is an error.

    ``_count`` is 1 in rows that may occur once per key, else NULL. Folding by the maximum
    would otherwise mix the values of repeated rows.
    """
    out = rows.groupBy(*key).agg(F.sum(COUNT).alias(COUNT), *(v.alias(n) for n, v in folds.items()))
    last = F.col(key[-1])
    shown = F.concat_ws(", ", *(F.col(c).cast("string") for c in key if not c.startswith("_")))
    repeated = F.raise_error(F.concat(F.lit("repeated cell: "), shown)).cast(rows.schema[key[-1]].dataType)
    checked = F.when(F.col(COUNT) > 1, repeated).otherwise(last).alias(key[-1])
    return out.select(*(checked if c == key[-1] else c for c in key), *folds)


def observed_times(df: DataFrame, spec: PanelSpec, start: int | None = None, *aggs: Column) -> DataFrame:
    """One row per key and observed time, with aggregates over the rows of its areas."""
    if start is not None:
        df = df.where(F.col(spec.time) >= start)
    times = add_block(df, spec)
    if not aggs:
        return times.select(*spec.keys, BLOCK, spec.time).distinct()
    return times.groupBy(*spec.keys, BLOCK, spec.time).agg(*aggs)


def as_runs(times: DataFrame, spec: PanelSpec) -> DataFrame:
    """Per key and block, its times in order: ``_run array<struct<time, ...>>``."""
    moment = F.struct(spec.time, *(c for c in times.columns if c not in (*spec.keys, BLOCK, spec.time)))
    return times.groupBy(*spec.keys, BLOCK).agg(F.sort_array(F.collect_list(moment)).alias(RUN))


def product(left: DataFrame, right: DataFrame, right_rows: int) -> DataFrame:
    """Every row of ``left`` with every row of ``right``, the smaller side, spread over all tasks.

    Rows of the left side are dealt to as many strips as there are shuffle partitions, and the
    right side goes to each strip; beyond ``STRIP`` rows it is cut into parts, and the left side
    goes to each part. So no task holds a whole side, whatever the product's size.
    """
    strips = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, -(-right_rows // STRIP))
    dealt = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("_strip", dealt(left, strips)).withColumn("_part", every(parts))
    b = right.withColumn("_part", dealt(right, parts)).withColumn("_strip", every(strips))
    return a.join(b, ["_strip", "_part"]).drop("_strip", "_part")


def _whole_panel(df: DataFrame, spec: PanelSpec, areas, start) -> tuple[DataFrame, DataFrame]:
    """Every area and every time of the panel for each key, observed there or not.

    Distinct values are found where they are and only counted on the driver; the times are
    gathered by block, which bounds each list.
    """
    groups = df.select(*spec.keys).distinct()
    times = df if start is None else df.where(F.col(spec.time) >= start)
    named = df if areas is None else df.where(F.col(spec.area).isin(*areas))
    all_areas = named.select(spec.area).distinct()
    blocks = as_runs(add_block(times.select(spec.time).distinct(), spec), spec.with_(keys=()))
    return product(groups, all_areas, all_areas.count()), product(groups, blocks, blocks.count())


def _series_blocks(
    df: DataFrame, series: DataFrame, runs: DataFrame, spec: PanelSpec, contexts: Sequence[Context]
) -> tuple[DataFrame, list[str]]:
    """One row per ``(series, block)`` with its run, offset and context, and the names in it."""
    # A broadcast join would tell the partitioning of stored buckets by the columns of either side,
    # which no longer equals that of the rows; after a sort-merge join the cells are dealt anew.
    last = (lambda df: df.hint("merge")) if spec.buckets else (lambda df: df)
    if spec.one_block:
        return series.join(last(runs), list(spec.keys)).withColumn(OFFSET, F.lit(0)), []
    # Only block numbers meet the series first, so that the join which brings the
    # times is by (keys, block) and no row of it yields more than one block of cells.
    offsets = runs.select(*spec.keys, BLOCK, F.size(RUN).alias("_size"))
    offsets = offsets.select(
        *spec.keys,
        BLOCK,
        F.coalesce(F.sum("_size").over(earlier(blocks_in_order(spec.keys))), F.lit(0)).alias(OFFSET),
    )
    runs = runs.join(offsets, [*spec.keys, BLOCK])
    numbers = offsets.groupBy(*spec.keys).agg(F.collect_list(BLOCK).alias("_blocks"))
    pairs = series.join(numbers, list(spec.keys)).select(*spec.series, F.explode("_blocks").alias(BLOCK))
    columns = {}
    if contexts:
        known = add_block(df, spec).groupBy(*spec.series, BLOCK)
        known = known.agg(*(s for c in contexts for s in c.summaries))
        table = pairs.join(runs, [*spec.keys, BLOCK]).join(known, [*spec.series, BLOCK], "left")
        own = [v.alias(n) for c in contexts for n, v in c.block.items()]
        # The times stay behind: only small rows are gathered per series.
        table = table.select(*spec.series, BLOCK, *own)
        for c in contexts:
            columns.update(c.columns(spec.series))
        pairs = table.select(*spec.series, BLOCK, *(v.alias(n) for n, v in columns.items()))
        bundle = F.struct(*columns).alias(CONTEXT)
        pairs = pairs.select(*spec.series, BLOCK, bundle)
    return pairs.join(last(runs), [*spec.keys, BLOCK]), list(columns)


def grid_blocks(
    df: DataFrame,
    spec: PanelSpec,
    *,
    start: int | None = None,
    areas: Sequence[str] | None = None,
    runs: DataFrame | None = None,
    nesting: bool = True,
    contexts: Sequence[Context] = (),
    skeleton: DataFrame | None = None,
) -> DataFrame:
    """The completed grid, partitioned by ``(keys, area, block)``.

    ``skeleton`` gives the same cells as ``df`` if that is cheaper to read keys from.
    ``runs`` overrides the grid times, see :func:`as_runs`; fields beyond the
    time are carried to every cell of that time. The result adds ``_pos``, the rank
    of the time among the grid times of the key from 0, and, unless the panel fits
    into one block, the columns of ``contexts``.

    The cells and the data rows are stacked and folded per cell, which equals the
    left join of the grid to the data and needs a single shuffle whose partitioning all
    later steps reuse. A panel stored by series needs none: Spark keeps the partitioning of
    a union whose sides have the same. A cell with several data rows is an error.
    """
    wanted = F.lit(True) if areas is None else F.col(spec.area).isin(*areas)
    skeleton = df if skeleton is None else skeleton
    if nesting:
        series = skeleton.where(wanted).select(*spec.series).distinct()
        runs = as_runs(observed_times(skeleton, spec, start), spec) if runs is None else runs
    else:
        series, runs = _whole_panel(skeleton, spec, areas, start)
    rows = df.where(wanted)
    rows = rows if start is None else rows.where(F.col(spec.time) >= start)
    extra = [f.name for f in runs.schema[RUN].dataType.elementType if f.name != spec.time]

    cells, context = _series_blocks(rows, series, runs, spec, contexts)
    bundle = [CONTEXT] if context else []
    if spec.buckets:
        # one row per block goes to the bucket of its series; the stored rows stay
        cells = cells.repartition(spec.buckets, *spec.series)
    cells = cells.select(
        *spec.series, BLOCK, OFFSET, *bundle, F.posexplode(RUN).alias("_i", "_moment")
    ).select(
        *spec.series,
        BLOCK,
        F.col("_moment")[spec.time].alias(spec.time),
        (F.col(OFFSET) + F.col("_i")).cast("bigint").alias(POS),
        *(F.col("_moment")[c].alias(c) for c in extra),
        # One row per block takes the context through the shuffle.
        *(F.when(F.col("_i") == 0, F.col(c)).alias(c) for c in bundle),
    )
    counted = add_block(rows, spec).withColumn(COUNT, F.lit(1))
    both = cells.unionByName(counted, allowMissingColumns=True)
    if not spec.buckets:
        both = both.repartition(*spec.series, BLOCK)
    key = [*spec.series, BLOCK, spec.time]
    folds = {c: F.max(c) for c in both.columns if c not in (*key, COUNT)}
    grid = single_rows(both, key, folds)
    if not context:
        return grid
    over = so_far(within_block(spec.series, spec.time))
    grid = grid.withColumn(CONTEXT, F.first(CONTEXT).over(over))
    return grid.select("*", *(F.col(CONTEXT)[c].alias(c) for c in context)).drop(CONTEXT)


def grid_lists(
    df: DataFrame, spec: PanelSpec, *, start: int | None = None, contexts: Sequence[Context] = ()
) -> DataFrame:
    """The completed grid with one row per ``(keys, area, block)``, its cells not yet told apart.

    ``_run`` has the grid times of the block in order and ``_known`` its data rows by time;
    ``_offset`` and the columns of ``contexts`` are NULL for rows whose key is unknown, which
    have no grid. Repeated cells are for the reader to refuse.
    """
    rows = df if start is None else df.where(F.col(spec.time) >= start)
    series = df.select(*spec.series).distinct()
    cells, context = _series_blocks(rows, series, as_runs(observed_times(df, spec, start), spec), spec, contexts)
    values = [c for c in rows.columns if c not in spec.cell]
    known = add_block(rows, spec).select(*spec.series, BLOCK, F.struct(spec.time, *values).alias(KNOWN))
    # Stacked and folded per block, as unknown keys are to meet, which they do not in a join.
    both = cells.unionByName(known, allowMissingColumns=True).repartition(*spec.series, BLOCK)
    once = [F.first(c, ignorenulls=True).alias(c) for c in (OFFSET, RUN, CONTEXT) if c in both.columns]
    out = both.groupBy(*spec.series, BLOCK).agg(*once, F.sort_array(F.collect_list(KNOWN)).alias(KNOWN))
    own = F.transform(KNOWN, lambda x: F.struct(x[spec.time].alias(spec.time)))
    out = out.withColumn(RUN, F.coalesce(F.col(RUN), own))
    return out.select(*spec.series, BLOCK, OFFSET, RUN, KNOWN, *(F.col(CONTEXT)[c].alias(c) for c in context))


def complete_grid(df: DataFrame, spec: PanelSpec = PANEL, *, nesting: bool = True, **options) -> DataFrame:
    """Add a row for every observed time of a key in each of its areas.

    A time that no area of the key observed does not appear. With
    ``nesting=False`` each key gets every area and time seen anywhere in the panel.
    """
    return grid_blocks(df, spec, nesting=nesting, **options).drop(BLOCK, POS)


def time_range(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Every whole time from the first to the last of each key."""
    ends = df.groupBy(*spec.keys).agg(
        F.min(spec.time).cast("bigint").alias("_lo"), F.max(spec.time).cast("bigint").alias("_hi")
    )
    first, last = F.col("_lo"), F.col("_hi")
    if not spec.one_block:
        # In two steps, so that no array is longer than a block or the number of blocks.
        span = F.lit(spec.block_span)
        each = F.explode(F.sequence(F.floor(first / span), F.floor(last / span)))
        ends = ends.withColumn("_part", each).repartition(*spec.keys, "_part")
        first = F.greatest(first, F.col("_part") * span)
        last = F.least(last, (F.col("_part") + 1) * span - 1)
    out = ends.select(*spec.keys, F.explode(F.sequence(first, last)).alias(spec.time))
    return out.withColumn(spec.time, F.col(spec.time).cast(df.schema[spec.time].dataType))


def complete_range(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Add a row for every whole time from the first to the last of the key."""
    runs = as_runs(add_block(time_range(df, spec), spec), spec)
    return grid_blocks(df, spec, runs=runs).drop(BLOCK, POS)


def pivot_area(df: DataFrame, value: str, areas: Sequence[str], spec: PanelSpec = PANEL) -> DataFrame:
    """One row per key and time with one column per area, holding ``value``."""
    wide = df.groupBy(*spec.keys, spec.time).pivot(spec.area, list(areas))
    one = F.when(F.count(value) > 1, F.raise_error(F.lit("repeated cell in a pivot")).cast(df.schema[value].dataType))
    return wide.agg(one.otherwise(F.first(value, ignorenulls=True)))


def unpivot_area(df: DataFrame, value: str, areas: Sequence[str], spec: PanelSpec = PANEL) -> DataFrame:
    """Inverse of :func:`pivot_area`; cells without a value become NULL rows."""
    return df.unpivot([*spec.keys, spec.time], list(areas), spec.area, value)
