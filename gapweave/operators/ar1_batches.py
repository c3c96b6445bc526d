"""The folds and the filter of the AR(1) model over a batch of series at once.

The same formulas as the column expressions of :mod:`gapweave.operators.ar1`: a task goes row
by row through all blocks of a batch together, the longest first, so that the blocks that
still go on are a prefix.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CELLS = 1 << 18  # rows worked on at once, unless one block is longer
FOLD = ("a", "b", "c", "eta", "j", "ll")
FILTERED = ("m_pred", "p_pred", "m", "p", "nll")

Rows = tuple[np.ndarray, np.ndarray, np.ndarray]  # value, variance, whether there is a value


def _steps(ends: np.ndarray, first: int, last: int, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Per row number the blocks that have it, counted from the longest, and where their rows are."""
    begin, size = ends[first:last][order], np.diff(ends[first : last + 1])[order]
    for t in range(int(size.max(initial=0))):
        going = int(np.searchsorted(-size, -t, "left"))
        yield going, begin[:going] + t


def fold(ends: np.ndarray, rows: Rows, first: int, last: int, state: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The six numbers of each block from ``first`` to before ``last``."""
    order = np.argsort(-np.diff(ends[first : last + 1]), kind="stable")
    rho, q = (state[c][first:last][order] for c in ("_rho", "_q"))
    out = [np.full(len(order), 1.0 if n == "a" else 0.0) for n in FOLD]
    for n, at in _steps(ends, first, last, order):
        y, r, seen = (x[at] for x in rows)
        rho_n, q_n = rho[:n], q[:n]
        s = q_n + r
        fa = np.where(seen, rho_n * r / s, rho_n)
        fb = np.where(seen, q_n * y / s, 0.0)
        fc = np.where(seen, q_n * r / s, q_n)
        feta = np.where(seen, rho_n * y / s, 0.0)
        fj = np.where(seen, rho_n * rho_n / s, 0.0)
        fll = np.where(seen, -0.5 * (np.log(2.0 * math.pi * s) + y * y / s), 0.0)
        a, b, c, eta, j, ll = (x[:n] for x in out)
        d = 1.0 + c * fj
        new = (
            fa * a / d,
            fa * (b + c * feta) / d + fb,
            fa * fa * c / d + fc,
            a * (feta - fj * b) / d + eta,
            a * a * fj / d + j,
            ll + fll - 0.5 * np.log(d) + (feta * b - 0.5 * fj * b * b + 0.5 * c * feta * feta) / d,
        )
        for x, v in zip(out, new):
            x[:n] = v
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return [x[back] for x in out]


def filtered(ends: np.ndarray, rows: Rows, first: int, last: int, state: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Predicted and filtered state of each row of the blocks, and its part of the objective."""
    order = np.argsort(-np.diff(ends[first : last + 1]), kind="stable")
    m, p, rho, q = (state[c][first:last][order] for c in ("_m", "_p", "_rho", "_q"))
    base = ends[first]
    out = [np.empty(ends[last] - base) for _ in FILTERED]
    for n, at in _steps(ends, first, last, order):
        y, r, seen = (x[at] for x in rows)
        m_pred = rho[:n] * m[:n]
        p_pred = rho[:n] * rho[:n] * p[:n] + q[:n]
        total, gap = p_pred + r, y - m_pred
        m = np.where(seen, m_pred + p_pred / total * gap, m_pred)
        p = np.where(seen, p_pred * r / total, p_pred)
        nll = np.where(seen, 0.5 * (np.log(2.0 * math.pi * total) + gap * gap / total), 0.0)
        for x, v in zip(out, (m_pred, p_pred, m, p, nll)):
            x[at - base] = v
    return out


def pieces(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of blocks with at most ``CELLS`` rows, or one block."""
    first = 0
    while first < len(ends) - 1:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CELLS, "right")) - 1)
        yield first, last
        first = last


def _over_batches(
    table: DataFrame, kept: Sequence[str], numbers: Sequence[str], schema: str, work: Callable[..., list[pa.Array]]
) -> DataFrame:
    """Apply ``work`` to pieces of the batches: ``kept`` and the columns that it gives.

    ``numbers`` are the columns with a block's state. ``work(ends, times, rows, first, last, state)``.
    """
    held = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in kept)
    names = [*kept, *(x.split(" ")[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            lists = column("obs")
            ends = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            items = lists.flatten()
            t, y, r = (items.field(c) for c in ("t", "y", "r"))
            seen = y.is_valid().to_numpy(zero_copy_only=False)
            rows = (*(c.to_numpy(zero_copy_only=False).astype(float) for c in (y, r)), seen)
            state = {c: column(c).to_numpy(zero_copy_only=False).astype(float) for c in numbers}
            own = [column(c) for c in kept]
            with np.errstate(all="ignore"):
                for first, last in pieces(ends):
                    out = work(ends, t, rows, first, last, state)
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in own), *out], names=names)

    return table.select(*dict.fromkeys([*kept, *numbers]), "obs").mapInArrow(run, ", ".join([held, schema]))


def fold_blocks(table: DataFrame, kept: Sequence[str]) -> DataFrame:
    """``kept`` and ``e``, the fold of the rows of each block at its ``_rho`` and ``_q``."""

    def work(ends, t, rows, first, last, state):
        return [pa.StructArray.from_arrays([pa.array(x) for x in fold(ends, rows, first, last, state)], names=list(FOLD))]

    return _over_batches(table, kept, ["_rho", "_q"], f"e struct<{','.join(f'{n}:double' for n in FOLD)}>", work)


def filter_blocks(table: DataFrame, kept: Sequence[str], time_type: str) -> DataFrame:
    """``kept`` and ``states``, the filtered rows of each block from the state ``_m, _p`` before it."""

    def work(ends, t, rows, first, last, state):
        begin, end = int(ends[first]), int(ends[last])
        values = [pa.array(x) for x in filtered(ends, rows, first, last, state)]
        items = pa.StructArray.from_arrays([t.slice(begin, end - begin), *values], names=["t", *FILTERED])
        return [pa.ListArray.from_arrays(pa.array(ends[first : last + 1] - begin, pa.int32()), items)]

    fields = ",".join([f"t:{time_type}", *(f"{n}:double" for n in FILTERED)])
    return _over_batches(table, kept, ["_m", "_p", "_rho", "_q"], f"states array<struct<{fields}>>", work)
