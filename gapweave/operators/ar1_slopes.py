"""The folds of the AR(1) model with exact derivatives in its two parameters.

The same runs as in :mod:`gapweave.operators.ar1`, each of their numbers with its slopes and
curvatures in ``log_pe`` and ``logit_rho``, so that one pass over the rows gives the objective,
its gradient and its curvature. A task works on a batch of series at once, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gapweave.operators.duals import PARTS, Dual

NUMBERS = ("a", "b", "c", "eta", "j", "ll")
MEAN_NUMBERS = ("b1", "eta1", "l1", "l2")
NOTHING = Dual(0.0)
LEAST = 1e-200  # keeps the innovation variance above zero at rho = 1
CELLS = 1 << 18  # rows worked on at once, unless one block is longer

Run = dict[str, Dual]


def names(mean: bool) -> tuple[str, ...]:
    return NUMBERS + (MEAN_NUMBERS if mean else ())


def parameters(log_pe: np.ndarray, logit_rho: np.ndarray) -> tuple[Dual, Dual, Dual]:
    """Variance of the state, coefficient and innovation variance."""
    p = np.exp(2.0 * log_pe)
    r = -1.0 + 2.0 / (1.0 + np.exp(-logit_rho))
    w = 1.0 - r * r  # twice the slope of r in its logit
    w_y, w_yy = -r * w, r * r * w - 0.5 * w * w
    q = np.maximum(p * w, LEAST)
    return (
        Dual(p, x=2.0 * p, xx=4.0 * p),
        Dual(r, y=0.5 * w, yy=-0.5 * r * w),
        Dual(q, 2.0 * q, p * w_y, 4.0 * q, 2.0 * p * w_y, p * w_yy),
    )


def identity(mean: bool) -> Run:
    return {n: Dual(1.0) if n == "a" else NOTHING for n in names(mean)}


def row(y: np.ndarray, r: np.ndarray, rho: Dual, q: Dual, mean: bool) -> Run:
    """Effect of one row of each series; a value that is NaN tells nothing."""
    seen = ~np.isnan(y)
    y, r = np.where(seen, y, 0.0), np.where(seen, r, 1.0)
    s = q + r
    i = s.inverse()
    qi, ri = q * i, rho * i
    level = s.log() + np.log(2.0 * np.pi)
    out = {"a": ri * r, "b": qi * y, "c": qi * r, "eta": ri * y, "j": ri * rho, "ll": (level + i * (y * y)) * -0.5}
    if mean:
        out |= {"b1": qi, "eta1": ri, "l1": i * y, "l2": i}
    unseen = {"a": rho, "c": q}
    return {n: v.where(seen, unseen.get(n, NOTHING)) for n, v in out.items()}


def combine(e: Run, f: Run, mean: bool) -> Run:
    """Runs ``e`` followed by runs ``f``."""
    d = e["c"] * f["j"] + 1.0
    i = d.inverse()
    t, g = f["a"] * i, e["a"] * i  # shares of the state and of the information that pass
    u, w = e["b"] + e["c"] * f["eta"], f["eta"] - f["j"] * e["b"]
    # 2*eta*b - j*b^2 + c*eta^2
    met = e["b"] * (f["eta"] + w) + f["eta"] * (u - e["b"])
    out = {
        "a": t * e["a"],
        "b": t * u + f["b"],
        "c": t * f["a"] * e["c"] + f["c"],
        "eta": g * w + e["eta"],
        "j": g * e["a"] * f["j"] + e["j"],
        "ll": e["ll"] + f["ll"] + (d.log() - met * i) * -0.5,
    }
    if mean:
        u1, w1 = e["b1"] + e["c"] * f["eta1"], f["eta1"] - f["j"] * e["b1"]
        bent = e["b1"] * (f["eta1"] + w1) + f["eta1"] * (u1 - e["b1"])
        out |= {
            "b1": t * u1 + f["b1"],
            "eta1": g * w1 + e["eta1"],
            "l1": e["l1"] + f["l1"] - (f["eta"] * u1 + e["b"] * w1) * i,
            "l2": e["l2"] + f["l2"] - bent * i,
        }
    return out


def of_series(e: Run, p0: Dual, mean: bool) -> Run:
    """Objective ``nll`` of whole series and, with a mean, its equation's ``total`` and ``info``."""
    d = p0 * e["j"] + 1.0
    s = p0 * d.inverse()
    out = {"nll": (e["ll"] + (s * e["eta"] * e["eta"] - d.log()) * 0.5) * -1.0}
    if mean:
        out |= {"total": e["l1"] - s * e["eta"] * e["eta1"], "info": e["l2"] - s * e["eta1"] * e["eta1"]}
    return out


def at_best_mean(one: Run) -> Run:
    """Objective at the best mean; series that see nothing have none."""
    info = one["info"]
    known = info.v > 0
    info = Dual(np.where(known, info.v, 1.0), *info.parts[1:])
    better = one["nll"] - one["total"] * one["total"] * info.inverse() * 0.5
    return {"nll": better.where(known, one["nll"])}


def _packed(run: Run, n: int) -> pa.Array:
    """A list of numbers for each of ``n`` series, six a number."""
    columns = [np.broadcast_to(np.asarray(p, float), (n,)) for d in run.values() for p in d.parts]
    flat = np.stack(columns, axis=1).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(columns)), pa.int32()), pa.array(flat))


def _read(flat: np.ndarray, kept: Sequence[str]) -> Run:
    """Numbers from an array ``(..., 6 * numbers)``."""
    k = len(PARTS)
    return {n: Dual(*(flat[..., k * i + j] for j in range(k))) for i, n in enumerate(kept)}


def _pieces(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of lists with at most ``CELLS`` items, or one list."""
    first = 0
    while first < len(ends) - 1:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CELLS, "right")) - 1)
        yield first, last
        first = last


def _rows_of(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))), lists.flatten()


def fold(lists: pa.Array, log_pe: np.ndarray, logit_rho: np.ndarray, mean: bool, parts: bool) -> Iterator[tuple[int, int, Run]]:
    """Fold each list of rows ``(y, r)``, or of ``parts`` folded before: ``(first, last, runs)``."""
    ends, items = _rows_of(lists)
    if parts:
        e = items.field("e")
        width = len(names(mean)) * len(PARTS)
        flat = e.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    else:
        y, r = (items.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "r"))
    for first, last in _pieces(ends):
        begin, size = ends[first:last], np.diff(ends[first : last + 1])
        order = np.argsort(-size, kind="stable")  # the longest first, so that those still going are a prefix
        _, rho, q = parameters(log_pe[first:last][order], logit_rho[first:last][order])
        done: list[tuple[int, Run]] = []
        run, going = identity(mean), len(order)
        for t in range(int(size.max(initial=0))):
            left = int(np.searchsorted(-size[order], -t, "left"))  # lists longer than t
            if left < going:
                done.append((left, _cut(run, left, going)))
                run, going = _cut(run, 0, left), left
            at = begin[order[:going]] + t
            if parts:
                new = _read(flat[at], names(mean))
            else:
                cut = lambda d: Dual(*(p if isinstance(p, float) else p[:going] for p in d.parts))
                new = row(y[at], r[at], cut(rho), cut(q), mean)
            run = combine(run, new, mean)
        done.append((0, _cut(run, 0, going)))
        whole = {
            n: Dual(*(_joined([(at, getattr(part[n], s)) for at, part in done], order, going_to=len(order)) for s in Dual.__slots__))
            for n in names(mean)
        }
        yield first, last, whole


def _cut(run: Run, first: int, last: int) -> Run:
    of = lambda p: np.full(last - first, p) if np.ndim(p) == 0 else p[first:last]
    return {n: Dual(*map(of, d.parts)) for n, d in run.items()}


def _joined(parts: list[tuple[int, np.ndarray]], order: np.ndarray, going_to: int) -> np.ndarray:
    out = np.empty(going_to)
    for at, values in parts:
        out[order[at : at + len(values)]] = values
    return out


def fold_batches(rows: DataFrame, lists: str, out: str, *, mean: bool, parts: bool, whole: bool, best: bool) -> DataFrame:
    """Add ``out``, the numbers of each row's list, in place of the list.

    ``rows`` has the tried point as ``_st.try_x`` and ``_st.try_y``. With ``whole`` the lists
    are whole series and the numbers are their objective; ``best`` takes it at the best mean.
    """
    kept = [c for c in rows.columns if c != lists]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), f"`{out}` array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state = batch.column(batch.schema.get_field_index("_st"))
            x, y = (state.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("try_x", "try_y"))
            held = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            with np.errstate(all="ignore"):
                for first, last, folded in fold(batch.column(batch.schema.get_field_index(lists)), x, y, mean, parts):
                    if whole:
                        folded = of_series(folded, parameters(x[first:last], y[first:last])[0], mean)
                        folded = at_best_mean(folded) if best else folded
                    columns = [*(c.slice(first, last - first) for c in held), _packed(folded, last - first)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept, out])

    return rows.mapInArrow(run, schema)


def best_mean_batches(rows: DataFrame, column: str) -> DataFrame:
    """Replace ``nll``, ``total`` and ``info`` in a list of numbers by the objective at the best mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            flat = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            with np.errstate(all="ignore"):
                found = at_best_mean(_read(flat, ("nll", "total", "info")))
            yield batch.set_column(at, column, _packed(found, batch.num_rows))

    return rows.mapInArrow(run, rows.schema)
