"""Join of a panel to spans of time, such as closures or regimes of an area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gapweave.spec import PANEL, PanelSpec

BIN = "_bin"


def join_intervals(
    df: DataFrame,
    spans: DataFrame,
    spec: PanelSpec = PANEL,
    *,
    columns: Sequence[str] = (),
    on: Sequence[str] | None = None,
    start: str = "start",
    end: str = "end",
    how: str = "left",
    width: int = 64,
) -> DataFrame:
    """Each row of ``df`` with each of ``spans`` that its time lies in, both ends included.

    Rows meet within ``on``, by default the series. ``how="left"`` keeps rows outside all spans
    once, with NULLs; ``"inner"`` drops them. A span without start or end is open there; one that
    ends before it starts holds no time. Overlapping spans give a row each, in no order.

    Time is cut into bins of ``width`` units. A row is in one bin, a span in all that it touches,
    so both meet in an equality join by ``(on, bin)`` and each pair at most once; the ends are
    then compared exactly. Open spans reach as far as the panel, whose extent is measured if
    ``spec`` does not have it. Choose ``width`` near the length of the spans.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how must be 'left' or 'inner', not {how!r}")
    keys, time = list(spec.series if on is None else on), spec.time
    taken = sorted({start, end, *columns} & set(df.columns))
    if taken:
        raise ValueError(f"columns of both tables: {taken}; rename those of the spans")
    extent = spec.extent or spec.measured(df).extent or (0, -1)
    bins = lambda t: F.floor(t / F.lit(width))
    first = F.greatest(F.coalesce(F.col(start), F.lit(extent[0])), F.lit(extent[0]))
    last = F.least(F.coalesce(F.col(end), F.lit(extent[1])), F.lit(extent[1]))
    touched = F.when(first <= last, F.sequence(bins(first), bins(last)))
    own = {k: f"_{k}" for k in keys}
    right = spans.select(*(F.col(k).alias(n) for k, n in own.items()), start, end, *columns, F.explode(touched).alias(BIN))
    left = df.withColumn("_time_bin", bins(F.col(time)))
    meets = F.col("_time_bin") == F.col(BIN)
    for k, n in own.items():
        meets = meets & (F.col(k) == F.col(n))
    inside = (F.col(start).isNull() | (F.col(time) >= F.col(start))) & (F.col(end).isNull() | (F.col(time) <= F.col(end)))
    return left.join(right, meets & inside, how).select(*df.columns, start, end, *columns)
