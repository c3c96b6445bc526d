"""Linear interpolation along a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gapweave.operators.blocks import (
    BLOCK,
    add_block,
    blocks_in_order,
    earlier,
    everything,
    so_far,
    whole_block,
    with_context,
    within_block,
)
from gapweave.operators.grid import OFFSET, POS, RUN, Context
from gapweave.spec import PANEL, PanelSpec

SKIPPED = "_skipped"  # grid rows of the key before the start


def _point(pos, x, v) -> Column:
    return F.struct(pos.alias("pos"), x.alias("x"), v.cast("double").alias("v"))


def abscissa(by: str, spec: PanelSpec) -> str:
    names = {"position": POS, "time": spec.time}
    if by not in names:
        raise ValueError(f"by must be one of {sorted(names)}, not {by!r}")
    return names[by]


def _carried(columns: Sequence[str], keys: Sequence[str]) -> dict[str, Column]:
    """Rows of the series; known points nearest to a block in earlier and later ones."""
    forwards, backwards = blocks_in_order(keys), blocks_in_order(keys, backwards=True)
    out = {"_rows": F.sum("_size").over(everything(forwards))}
    for c in columns:
        out[f"_before_{c}"] = F.last(f"_last_{c}", ignorenulls=True).over(earlier(forwards))
        out[f"_after_{c}"] = F.last(f"_first_{c}", ignorenulls=True).over(earlier(backwards))
        out[f"_n_{c}"] = F.sum(f"_known_{c}").over(everything(forwards))
    return out


def interpolation_context(columns: Sequence[str], spec: PanelSpec, x: str, start: int | None = None) -> Context:
    """Context of :func:`interpolate_blocks` from the data rows of each block."""
    summaries, block = [], {"_size": F.size(RUN)}
    if start is not None:
        block[SKIPPED] = F.size(F.filter(RUN, lambda moment: moment[spec.time] < start))
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col(spec.time))
        summaries += [
            F.max(at).alias(f"_last_t_{c}"),
            F.max_by(c, at).alias(f"_last_v_{c}"),
            F.min(at).alias(f"_first_t_{c}"),
            F.min_by(c, at).alias(f"_first_v_{c}"),
            F.count(c).alias(f"_known_{c}"),
        ]
        for end in ("first", "last"):
            t = F.col(f"_{end}_t_{c}")
            index = F.array_position(F.transform(RUN, lambda moment: moment[spec.time]), t)
            pos = F.col(OFFSET) + index - 1
            point = _point(pos, pos if x == POS else t, F.col(f"_{end}_v_{c}"))
            block[f"_{end}_{c}"] = F.when(t.isNotNull(), point)
        block[f"_known_{c}"] = F.col(f"_known_{c}")

    def carried(keys):
        early = {} if start is None else {SKIPPED: F.sum(SKIPPED).over(everything(blocks_in_order(keys)))}
        return _carried(columns, keys) | early

    return Context(summaries, block, carried)


def interpolate_blocks(
    df: DataFrame,
    keys: Sequence[str],
    spec: PanelSpec,
    columns: Sequence[str],
    *,
    x: str,
    maxgap: int = 20,
    start: int | None = None,
) -> DataFrame:
    """Interpolate ``columns`` of rows that are partitioned by ``(keys, block)``.

    ``x`` is the abscissa, ``_pos`` the row number from 0 that ``maxgap`` counts in.
    The nearest value is carried past the first and last one; runs of more than
    ``maxgap`` missing rows, and series with fewer than two values, are left alone.
    Unless the panel fits into one block, the rows carry the columns of
    :func:`interpolation_context`. With ``start`` the columns have no values before it, and
    runs of missing rows are counted from there.
    """
    forwards, backwards = within_block(keys, spec.time), within_block(keys, spec.time, backwards=True)
    whole = whole_block(keys, spec.time)
    ends = [] if not spec.one_block else [(F.max(POS).over(whole) + 1).alias("_rows")]
    helpers, first = ["_rows"], F.lit(0)
    if start is not None:
        helpers, first = [*helpers, SKIPPED], F.col(SKIPPED)
        if spec.one_block:
            ends.append(F.count(F.when(F.col(spec.time) < start, 1)).over(whole).alias(SKIPPED))
    for c in columns:
        here = F.when(F.col(c).isNotNull(), _point(F.col(POS), F.col(x), F.col(c)))
        p = F.last(here, ignorenulls=True).over(so_far(forwards))
        q = F.last(here, ignorenulls=True).over(so_far(backwards))
        if spec.one_block:
            ends.append(F.count(c).over(whole).alias(f"_n_{c}"))
        else:
            p, q = F.coalesce(p, F.col(f"_before_{c}")), F.coalesce(q, F.col(f"_after_{c}"))
            helpers += [f"_before_{c}", f"_after_{c}"]
        ends += [p.alias(f"_p_{c}"), q.alias(f"_q_{c}")]
        helpers += [f"_p_{c}", f"_q_{c}", f"_n_{c}"]
    df = df.select("*", *ends)
    filled = {}
    for c in columns:
        p, q = F.col(f"_p_{c}"), F.col(f"_q_{c}")
        share = F.try_divide((F.col(x) - p["x"]).cast("double"), (q["x"] - p["x"]).cast("double"))
        line = p["v"] + (q["v"] - p["v"]) * share
        value = F.when(p.isNull(), q["v"]).when(q.isNull(), p["v"]).otherwise(line)
        # Length of the run of missing rows this row belongs to.
        run = F.coalesce(q["pos"], F.col("_rows")) - F.coalesce(p["pos"], first - 1) - 1
        usable = F.col(c).isNull() & (F.col(f"_n_{c}") >= 2) & (run <= maxgap)
        filled[c] = F.when(usable, value).otherwise(F.col(c))
    return df.withColumns(filled).drop(*helpers)


def interpolate(
    df: DataFrame,
    columns: Sequence[str],
    spec: PanelSpec = PANEL,
    *,
    maxgap: int = 20,
    by: str = "position",
) -> DataFrame:
    """Interpolate columns of a panel whose missing periods are NULL cells.

    ``by="position"`` measures distance in rows, ``by="time"`` in time units.
    """
    x, keys = abscissa(by, spec), spec.series
    rank = (F.row_number().over(within_block(keys, spec.time)) - 1).cast("bigint")
    rows = add_block(df, spec).withColumn(POS, rank)
    if not spec.one_block:
        # Rows per block first, then positions, then the known points by position.
        rows = with_context(
            rows,
            keys,
            [F.count(F.lit(1)).alias("_size")],
            lambda series: {
                OFFSET: F.coalesce(F.sum("_size").over(earlier(blocks_in_order(series))), F.lit(0))
            },
        )
        rows = rows.withColumn(POS, F.col(OFFSET) + F.col(POS)).drop(OFFSET)
        summaries = [F.count(F.lit(1)).alias("_size")]
        for c in columns:
            at = F.when(F.col(c).isNotNull(), F.col(POS))
            point = _point(F.col(POS), F.col(x), F.col(c))
            summaries += [
                F.max_by(point, at).alias(f"_last_{c}"),
                F.min_by(point, at).alias(f"_first_{c}"),
                F.count(c).alias(f"_known_{c}"),
            ]
        rows = with_context(rows, keys, summaries, lambda series: _carried(columns, series))
    return interpolate_blocks(rows, keys, spec, columns, x=x, maxgap=maxgap).drop(BLOCK, POS)
