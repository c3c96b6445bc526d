"""Ordered work on series of any length, split into blocks of time.

A plain ``Window.partitionBy(series)`` puts a whole series into one task. Here the
window runs inside ``(series, block)``, and what it needs from other blocks comes
from a table with one row per block, aggregated before its shuffle and windowed by
series. Where the panel is known to fit into one block, the window alone is enough.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from gapweave.spec import PanelSpec

BLOCK = "_block"
SALT = "_salt"
FOUND = "_found"


def blocks_in_order(keys: Sequence[str], backwards: bool = False) -> WindowSpec:
    """The blocks of a series, first to last or last to first."""
    return Window.partitionBy(*keys).orderBy(F.desc(BLOCK) if backwards else F.asc(BLOCK))


def within_block(keys: Sequence[str], time: str, backwards: bool = False) -> WindowSpec:
    """The rows of a block, first to last or last to first."""
    return Window.partitionBy(*keys, BLOCK).orderBy(F.desc(time) if backwards else F.asc(time))


def so_far(over: WindowSpec) -> WindowSpec:
    return over.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def earlier(over: WindowSpec) -> WindowSpec:
    # Frames that end at the last row cost the square of their length; to look ahead,
    # take this one over the backwards order.
    return over.rowsBetween(Window.unboundedPreceding, -1)


def everything(over: WindowSpec) -> WindowSpec:
    return over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def whole_block(keys: Sequence[str], time: str) -> WindowSpec:
    # Ordered like the other windows, so that Spark runs them in one sort.
    return everything(within_block(keys, time))


def add_block(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.withColumn(BLOCK, spec.block())


def with_context(
    df: DataFrame,
    keys: Sequence[str],
    summaries: Sequence[Column],
    context: Callable[[Sequence[str]], dict[str, Column]],
) -> DataFrame:
    """Add per-block columns derived from all blocks of the same series.

    ``summaries`` aggregate one block; ``context`` turns the summary columns into
    the wanted ones by windows over the blocks of a series. The rows are joined by
    ``(keys, block)``, the partitioning that windows inside blocks use.
    """
    table = df.groupBy(*keys, BLOCK).agg(*summaries)
    columns = [c.alias(n) for n, c in context(keys).items()]
    return df.join(table.select(*keys, BLOCK, *columns), [*keys, BLOCK])


def neighbour(
    df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], step: int, edge: str | None
) -> DataFrame:
    """Add ``_adjacent``, a struct of ``columns`` in the row before (-1) or after (1).

    The struct is NULL if there is no such row. ``edge`` names a column with the
    struct beyond the end of the block, ``None`` if no other block exists.
    """
    shift = F.lag if step < 0 else F.lead
    own = F.struct(*columns)
    inside = shift(own, 1).over(within_block(keys, time))
    return df.withColumn("_adjacent", inside if edge is None else F.coalesce(inside, F.col(edge)))


def next_row(df: DataFrame, keys: Sequence[str], spec: PanelSpec, outputs: dict[str, str]) -> DataFrame:
    """Lead by one row along ``keys``: adds each output from its input column."""
    names = list(dict.fromkeys(outputs.values()))
    df, edge = add_block(df, spec), None
    if not spec.one_block:
        edge = "_edge"
        first = F.struct(*(F.col(f"_first_{c}").alias(c) for c in names))
        df = with_context(
            df,
            keys,
            [F.min_by(c, spec.time).alias(f"_first_{c}") for c in names],
            lambda series: {edge: F.lead(first, 1).over(blocks_in_order(series))},
        )
    df = neighbour(df, keys, spec.time, names, 1, edge)
    df = df.withColumns({out: F.col("_adjacent")[name] for out, name in outputs.items()})
    return df.drop("_adjacent", "_edge", BLOCK)


def salted(rows: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Spread rows over sub-groups by a hash of columns, as many as there are shuffle partitions."""
    salts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.withColumn(SALT, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))


def subgroups(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sub-groups that occur in salted rows."""
    return rows.select(*keys, SALT).distinct()


def join_on_group(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    missing: str | None = None,
    used: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to a table with one row per ``keys``.

    A group may own a large part of ``rows``, so each group is spread over sub-groups by a
    hash of the ``spread`` columns, as many as the session has shuffle partitions, which is
    set by the size of the data. ``groups`` is copied only to sub-groups that occur, so there
    are never more copies than rows; Spark broadcasts either table when its size allows. Rows
    without a group are left out, or, given ``missing``, are an error with that message.

    Given ``used``, the stored :func:`subgroups` of rows that are :func:`salted` already, the
    rows are not read for them again.
    """
    left = salted(rows, spread) if used is None else rows
    used = subgroups(left, keys) if used is None else used
    right = used.join(groups, list(keys))
    if missing is None:
        return left.join(right, [*keys, SALT]).drop(SALT)
    out = left.join(right.withColumn(FOUND, F.lit(True)), [*keys, SALT], "left")
    key = keys[0]
    shown = F.concat(F.lit(f"{missing}: "), F.concat_ws(", ", *(F.col(c).cast("string") for c in keys)))
    lost = F.raise_error(shown).cast(rows.schema[key].dataType)
    return out.withColumn(key, F.when(F.col(FOUND), F.col(key)).otherwise(lost)).drop(SALT, FOUND)
