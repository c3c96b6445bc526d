"""Linear interpolation over a batch of blocks at once.

The same rules as :func:`gapweave.operators.interpolate.interpolate_blocks`, for a grid whose
rows are one per block: its cells come into being in the task that fills them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapweave.operators.ar1_batches import pieces
from gapweave.operators.grid import KNOWN, OFFSET, POS, RUN
from gapweave.spec import PanelSpec


def _numbers(column: pa.Array, kind=float) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)


def _ends(lists: pa.Array) -> np.ndarray:
    return np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))


def _point(struct: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, abscissa, value and presence of the point that a block takes from another one."""
    given = struct.is_valid().to_numpy(zero_copy_only=False)
    pos, x = (_numbers(struct.field(c), np.int64) for c in ("pos", "x"))
    return pos, x, _numbers(struct.field("v")), given


def filled(
    values: np.ndarray,
    has: np.ndarray,
    block: np.ndarray,
    starts: np.ndarray,
    pos: np.ndarray,
    x: np.ndarray,
    before: tuple[np.ndarray, ...],
    after: tuple[np.ndarray, ...],
    known: np.ndarray,
    rows: np.ndarray,
    maxgap: int,
) -> tuple[np.ndarray, np.ndarray]:
    """A column of cells, block after block, with what can be interpolated, and which cells have a value.

    ``starts`` has the first cell of each block and the end; ``before`` and ``after`` the
    nearest points in other blocks, ``known`` and ``rows`` the values and rows of the series.
    """
    n, at = len(values), np.arange(len(values))
    last = np.maximum.accumulate(np.where(has, at, -1))
    following = np.minimum.accumulate(np.where(has, at, n)[::-1])[::-1]

    def point(nearest: np.ndarray, inside: np.ndarray, other: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        nearest = np.where(inside, nearest, 0)
        own = (np.where(inside, mine[nearest], theirs[block]) for mine, theirs in zip((pos, x, values), other))
        return (*own, inside | other[3][block])

    p_pos, p_x, p_v, p = point(last, last >= starts[block], before)
    q_pos, q_x, q_v, q = point(following, following < starts[block + 1], after)
    share = (x - p_x).astype(float) / (q_x - p_x).astype(float)
    value = np.where(~p, q_v, np.where(~q, p_v, p_v + (q_v - p_v) * share))
    run = np.where(q, q_pos, rows[block]) - np.where(p, p_pos, -1) - 1
    usable = ~has & (known[block] >= 2) & (run <= maxgap)
    return np.where(usable, value, values), has | usable


def interpolate_lists(
    lists: DataFrame, spec: PanelSpec, columns: Sequence[str], values: Sequence[str], *, x: str, maxgap: int
) -> DataFrame:
    """The cells of :func:`gapweave.operators.grid.grid_lists` with ``values``, of which ``columns`` are interpolated.

    The context is that of :func:`gapweave.operators.interpolate.interpolation_context`.
    """
    time_type = lists.schema[RUN].dataType.elementType[spec.time].dataType.simpleString()
    fields = ",".join([f"`{spec.time}`:{time_type}", *(f"`{c}`:double" for c in values)])
    keys = ", ".join(f"`{c}` {lists.schema[c].dataType.simpleString()}" for c in spec.series)
    names, span = [*spec.series, "_cells"], spec.block_span

    def cells(batch: pa.RecordBatch, ends: np.ndarray, first: int, last: int) -> pa.Array:
        part = batch.slice(first, last - first)
        column = lambda c: part.column(part.schema.get_field_index(c))
        times, starts = column(RUN).flatten().field(spec.time), ends[first : last + 1] - ends[first]
        size, t = np.diff(starts), times.to_numpy(zero_copy_only=False)
        block = np.repeat(np.arange(last - first), size)
        grid = column(OFFSET).is_valid().to_numpy(zero_copy_only=False)
        pos = _numbers(column(OFFSET), np.int64)[block] + np.arange(len(t)) - starts[block]
        where = pos if x == POS else t.astype(np.int64)

        # the data rows are put into their cells by the time since the block's first
        found = column(KNOWN).flatten()
        of = np.repeat(np.arange(last - first), np.diff(_ends(column(KNOWN))))
        since = lambda moment, number: number * span + (moment.astype(np.int64) - t[starts[number]])
        mine = since(found.field(spec.time).to_numpy(zero_copy_only=False), of)
        twice = np.flatnonzero(mine[1:] == mine[:-1])
        if len(twice):
            k = int(twice[0])
            shown = [*(column(c)[int(of[k])].as_py() for c in spec.series), found.field(spec.time)[k].as_py()]
            raise ValueError("repeated cell: " + ", ".join(str(v) for v in shown if v is not None))
        cell = np.searchsorted(since(t, block), mine)

        known_rows = _numbers(column("_rows"), np.int64)
        out = []
        for c in values:
            v, has = np.zeros(len(t)), np.zeros(len(t), bool)
            v[cell] = _numbers(found.field(c))
            has[cell] = found.field(c).is_valid().to_numpy(zero_copy_only=False)
            if c in columns:
                count = np.where(grid, _numbers(column(f"_n_{c}"), np.int64), 0)
                ends_of = (_point(column(f"_{side}_{c}")) for side in ("before", "after"))
                v, has = filled(v, has, block, starts, pos, where, *ends_of, count, known_rows, maxgap)
            out.append(pa.array(v, mask=~has, from_pandas=False))
        items = pa.StructArray.from_arrays([times, *out], names=[spec.time, *values])
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = _ends(batch.column(batch.schema.get_field_index(RUN)))
            with np.errstate(all="ignore"):
                for first, last in pieces(ends):
                    held = [batch.column(batch.schema.get_field_index(c)).slice(first, last - first) for c in spec.series]
                    yield pa.RecordBatch.from_arrays([*held, cells(batch, ends, first, last)], names=names)

    out = lists.mapInArrow(run, f"{keys}, _cells array<struct<{fields}>>")
    return out.select(*spec.series, F.inline("_cells"))
