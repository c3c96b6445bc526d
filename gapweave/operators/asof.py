"""Join of rows to the nearest row of another table in time, per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapweave.operators.blocks import BLOCK, add_block, blocks_in_order, earlier, so_far, with_context
from gapweave.spec import PANEL, PanelSpec

DIRECTIONS = ("backward", "forward", "nearest")


def join_asof(
    left: DataFrame,
    right: DataFrame,
    spec: PanelSpec = PANEL,
    *,
    columns: Sequence[str],
    on: Sequence[str] | None = None,
    direction: str = "backward",
    tolerance: int | None = None,
    time_name: str = "matched_time",
) -> DataFrame:
    """``left`` with ``columns`` of the row of ``right`` next to it in time.

    Rows meet within ``on``, by default the series. ``backward`` takes the last row of ``right``
    at or before the time, ``forward`` the first at or after it, ``nearest`` the closer of the
    two, the earlier one if they are as close. Without a row, or with none within
    ``tolerance`` time units, the columns are NULL; ``time_name`` tells the time that was found.
    Of several rows of ``right`` at one time the greatest counts, column by column in the order
    given, NULL being least. Rows of ``left`` may repeat and all stay.

    Both tables are laid on one time line, stacked and shuffled once by ``(on, block)``. A row
    looks around within its block; what lies in other blocks comes from a table with one row per
    block, so a series of any length is spread over many tasks.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}, not {direction!r}")
    keys, time = list(spec.series if on is None else on), spec.time
    taken = sorted({*columns, time_name} & set(left.columns))
    if taken:
        raise ValueError(f"columns of both tables: {taken}; rename those of the right one")
    seen = F.struct(F.col(time).alias("_at"), *columns).alias("_seen")
    rows = left.select(*keys, time, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    facts = right.where(F.col(time).isNotNull()).select(*keys, time, F.lit(0).alias("_side"), seen)
    both = add_block(facts.unionByName(rows, allowMissingColumns=True), spec)

    wanted = {"backward": ("_p",), "forward": ("_q",), "nearest": ("_p", "_q")}[direction]
    outside = {}
    if not spec.one_block:
        outside = {
            "_p": F.last("_last", ignorenulls=True).over(earlier(blocks_in_order(keys))),
            "_q": F.last("_first", ignorenulls=True).over(earlier(blocks_in_order(keys, backwards=True))),
        }
        # of the first time, too, the greatest row
        first = F.struct((-F.col("_seen._at")).alias("t"), F.col("_seen").alias("s"))
        ends = [F.max("_seen").alias("_last"), F.max_by("_seen", F.when(F.col("_seen").isNotNull(), first)).alias("_first")]
        both = with_context(both, keys, ends, lambda series: {f"{n}_edge": outside[n] for n in wanted})
    found: dict[str, Column] = {}
    for n in wanted:
        order = [F.col(time).desc() if n == "_q" else F.col(time).asc(), F.col("_side").asc(), F.col("_seen").asc()]
        near = F.last("_seen", ignorenulls=True).over(so_far(Window.partitionBy(*keys, BLOCK).orderBy(*order)))
        found[n] = F.coalesce(near, F.col(f"{n}_edge")) if outside else near
    both = both.withColumns(found).where("_row IS NOT NULL")
    gap = {n: F.abs(F.col(f"{n}._at") - F.col(time)) for n in wanted}
    if direction == "nearest":
        before, after = gap["_p"], gap["_q"]
        best = F.when(after.isNull() | (before <= after), F.col("_p")).otherwise(F.col("_q"))
    else:
        best = F.col(wanted[0])
    if tolerance is not None:
        best = F.when(F.abs(best["_at"] - F.col(time)) <= tolerance, best)
    out = both.select(F.col("_row.*"), best.alias("_best"))
    return out.select(
        *left.columns, F.col("_best._at").alias(time_name), *(F.col("_best")[c].alias(c) for c in columns)
    )
