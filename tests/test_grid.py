import itertools

import pytest

import gapweave.operators.grid as module
from brute import grid, random_panel
from conftest import as_dict
from gapweave.operators.grid import complete_grid, complete_range, pivot_area, unpivot_area
from gapweave.operators.ratio import lag_first_default
from gapweave.spec import PANEL

SPANS = [1024, 7, 1]


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("measured", [False, True])
def test_grid_of_observed_times(panel, span, measured):
    rows = random_panel(1)
    p = panel(rows)
    spec = PANEL.with_(block_span=span)
    spec = spec.measured(p) if measured else spec
    got = as_dict(complete_grid(p, spec), "rpn", "rpn_var", "rpw", "rpw_var")
    want = {
        (s, a, y): tuple(v) if v else (None,) * 4 for (s, a), cells in grid(rows).items() for y, v in cells
    }
    assert got == want


def test_whole_panel_grid(panel):
    rows = [("s", 1, "A", 1), ("s", 3, "B", 2), ("t", 5, "C", 3)]
    got = as_dict(complete_grid(panel(rows), nesting=False), "rpn")
    assert len(got) == 2 * 3 * 3 and got["t", "A", 1] is None and got["t", "C", 5] == 3.0
    assert len(complete_grid(panel(rows)).collect()) == 4 + 1


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("strip", [1000, 2])
def test_whole_panel_grid_in_parts(panel, span, strip, monkeypatch):
    monkeypatch.setattr(module, "STRIP", strip)
    rows = random_panel(5, species=3)
    p = panel(rows)
    known = {r[:3]: r[3] for r in rows}
    got = as_dict(complete_grid(p, PANEL.with_(block_span=span), nesting=False), "rpn", key=("species", "year", "strata"))
    sides = [{r[i] for r in rows} for i in range(3)]
    assert got == {k: known.get(k) for k in itertools.product(*sides)}


def test_whole_panel_grid_of_nothing(panel):
    assert complete_grid(panel([]), nesting=False).collect() == []


@pytest.mark.parametrize("span", SPANS)
def test_full_range(panel, span):
    rows = [("s", -2, "A", 1), ("s", 3, "B", 2), ("t", 5, "C", 3)]
    got = as_dict(complete_range(panel(rows), PANEL.with_(block_span=span)), "rpn")
    assert set(got) == {("s", a, y) for a in "AB" for y in range(-2, 4)} | {("t", "C", 5)}
    assert got["s", "A", -2] == 1.0 and got["s", "A", 3] is None


def test_pivot_and_back(panel):
    rows = [("s", 1, "A", 1), ("s", 1, "B", 2), ("s", 2, "B", 5)]
    wide = pivot_area(panel(rows), "rpn", ["A", "B"])
    assert {(r.year, r.A, r.B) for r in wide.collect()} == {(1, 1.0, 2.0), (2, None, 5.0)}
    assert as_dict(unpivot_area(wide, "rpn", ["A", "B"]), "rpn") == {
        ("s", "A", 1): 1.0,
        ("s", "B", 1): 2.0,
        ("s", "A", 2): None,
        ("s", "B", 2): 5.0,
    }


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("measured", [False, True])
def test_lag_default_is_own_first_value(panel, span, measured):
    rows = random_panel(2)
    p = panel(rows)
    spec = PANEL.with_(block_span=span)
    spec = spec.measured(p) if measured else spec
    got = as_dict(lag_first_default(p, spec), "rpn_lag", "rpw_lag")
    want = {}
    for (s, a), cells in grid(rows).items():
        for i, (y, _) in enumerate(cells):
            v = cells[max(i - 1, 0)][1]
            want[s, a, y] = (v[0], v[2]) if v else (None, None)
    assert got == want
