"""Folds and filter of the AR(1) model over batches of blocks."""

import math
import random

import numpy as np

from gapweave.operators import ar1, ar1_batches
from gapweave.spec import PANEL


def _plain(obs, m, p, rho, q):
    out = []
    for y, r in obs:
        m, p, nll = rho * m, rho * rho * p + q, 0.0
        before = (m, p)
        if y is not None:
            total, gap = p + r, y - m
            m, p, nll = m + p / total * gap, p * r / total, 0.5 * (math.log(2 * math.pi * total) + gap * gap / total)
        out.append((*before, m, p, nll))
    return out


def test_blocks_of_different_length_are_filtered_row_by_row():
    rng = random.Random(5)
    lists = [[(rng.gauss(0, 2), 0.1 + rng.random()) if rng.random() < 0.6 else (None, None) for _ in range(n)] for n in (3, 0, 70, 1, 33)]
    flat = [x for obs in lists for x in obs]
    ends = np.append(0, np.cumsum([len(x) for x in lists]))
    rows = (*(np.array([np.nan if x[i] is None else x[i] for x in flat]) for i in (0, 1)), np.array([x[0] is not None for x in flat]))
    state = {"_m": np.linspace(-1, 1, 5), "_p": np.linspace(1, 2, 5), "_rho": np.linspace(0.5, 0.9, 5), "_q": np.linspace(0.2, 0.6, 5)}
    for first, last in ((0, 5), (1, 4)):
        got = np.array(ar1_batches.filtered(ends, rows, first, last, state)).T
        want = [x for i in range(first, last) for x in _plain(lists[i], *(state[c][i] for c in ("_m", "_p", "_rho", "_q")))]
        np.testing.assert_allclose(got, want, rtol=1e-12)


def test_edges_read_the_rows_once(spark, panel):
    rows = [("a", year, area, 5.0 + year % 7, 1.0) for year in range(40) for area in ("x", "y") if year % 3]
    spec = PANEL.with_(block_span=4)
    series = ar1._with_params(ar1.ar1_series(panel(rows), spec), (0.5, 2.0))
    plan = ar1._edges(series, ["species", "measure", "strata"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_long_blocks_and_short_ones_give_the_same(spark, panel):
    rows = [("a", year, area, 5.0 + year % 7, 1.0 + year % 3) for year in range(80) for area in ("x", "y") if (year + len(area)) % 3]
    found = []
    for span in (1024, 5):
        spec = PANEL.with_(block_span=span)
        out = ar1.ar1_filter(ar1.ar1_series(panel(rows), spec), (0.5, 2.0), spec).orderBy("species", "measure", "strata", "year")
        found.append([tuple(r) for r in out.select("m_pred", "p_pred", "m", "p", "nll").collect()])
    assert len(found[0]) == 2 * len({r[1:3] for r in rows})
    np.testing.assert_allclose(found[0], found[1], rtol=1e-9, atol=1e-12)
