import math

import pytest
from pyspark.sql import functions as F

from brute import grid, interpolate as by_hand, random_panel, ratio_fill
from conftest import as_dict
from gapweave.operators.grid import complete_grid
from gapweave.operators.interpolate import interpolate
from gapweave.operators.linear import fill_linear
from gapweave.operators.ratio import assign_mean_cv_variance, fill_ratio, reference_ratio
from gapweave.operators.several import fill_several
from gapweave.operators.share import check_alternating, fill_ltmean, longterm_shares
from gapweave.spec import PANEL

SPANS = [1024, 7, 1]


def close(a, b):
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)


def assert_same(got, want):
    assert set(got) == set(want)
    for k, v in want.items():
        g = got[k]
        pairs = zip(g, v) if isinstance(v, tuple) else [(g, v)]
        assert all(close(*p) for p in pairs), (k, g, v)


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("measured", [False, True])
@pytest.mark.parametrize("reference", [None, "C"])
def test_ratio_fill(panel, span, measured, reference):
    rows = random_panel(3, areas=("A", "B", "C", "D"))
    p = panel(rows).repartition(5)
    spec = PANEL.with_(block_span=span)
    spec = spec.measured(p) if measured else spec
    got = as_dict(fill_ratio(p, spec, targets=["A", "B"], reference=reference, start=2), "rpn", "rpn_var")
    assert_same(got, ratio_fill(rows, ("A", "B"), reference, 2))


def test_second_gap_stays_missing_and_lead_in_is_used(panel):
    rows = [("s", y, "G", g) for y, g in ((1, 10), (2, 20), (3, 30), (4, 60))]
    rows += [("s", 1, "A", 5, 1), ("s", 4, "A", 8, 1)]
    got = as_dict(fill_ratio(panel(rows), targets=["A"], start=2, label="x"), "rpn", "rpn_var")
    assert got["s", "A", 2][0] == 10.0 and got["s", "A", 3] == (None, None)
    mean = (1 / 5 + 1 / 8) / 2
    assert got["s", "A", 2][1] == pytest.approx((mean * 10.0) ** 2)
    assert ("s", "A", 1) not in got


def test_time_without_reference_row_is_stepped_over(panel):
    rows = [("s", 1, "G", 10), ("s", 3, "G", 30), ("s", 2, "A", 4), ("s", 1, "A", 2)]
    for span in SPANS:
        spec = PANEL.with_(block_span=span)
        got = as_dict(reference_ratio(panel(rows), spec, targets=["A"]), "rpn_ref", "rpn_ref_prev", key=("year",))
        assert got == {(1,): (10.0, 10.0), (2,): (None, None), (3,): (30.0, 10.0)}


def test_missing_reference_value_differs_between_area_and_total(panel):
    rows = [("s", 1, "G", 10), ("s", 2, "G", None), ("s", 3, "G", 30), ("s", 1, "A", 2)]
    total = as_dict(reference_ratio(panel(rows), targets=["A"]), "rpn_ref", key=("year",))
    area = as_dict(reference_ratio(panel(rows), targets=["A"], reference="G"), "rpn_ref", key=("year",))
    assert total[2,] == 0.0 and area[2,] is None


def test_ratio_fill_is_linear_in_the_target(panel):
    rows = random_panel(4)
    double = [(s, y, a, v if a == "C" or v is None else 2 * v, *r) for s, y, a, v, *r in rows]
    one = as_dict(fill_ratio(panel(rows), targets=["A", "B"], start=0), "rpn")
    two = as_dict(fill_ratio(panel(double), targets=["A", "B"], start=0), "rpn")
    for k, v in one.items():
        assert close(two[k], v if v is None or k[1] == "C" else 2 * v)


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("measured", [False, True])
def test_mean_cv_variance(panel, span, measured):
    rows = random_panel(5)
    p = complete_grid(panel(rows))
    spec = PANEL.with_(block_span=span)
    spec = spec.measured(p) if measured else spec
    out = assign_mean_cv_variance(p, spec, targets=["A", "C"], start=3, end=20)
    got = as_dict(out, "mean_cv", "rpn_var", "rpw_var")
    want = {}
    for (s, a), cells in grid(rows).items():
        cvs = [math.sqrt(v[1]) / v[0] for _, v in cells if v and v[0] is not None and v[1] is not None]
        mean = sum(cvs) / len(cvs) if cvs else 0.0
        for y, v in cells:
            v = v or [None] * 4
            cv = mean if y >= 3 else 0.05
            assign = lambda x, var: (cv * x) ** 2 if a in "AC" and 3 <= y <= 20 and x is not None and var is None else var
            want[s, a, y] = (cv, assign(v[0], v[1]), assign(v[2], v[3]))
    assert_same(got, want)


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("measured", [False, True])
@pytest.mark.parametrize("by", ["position", "time"])
def test_interpolation(panel, span, measured, by):
    rows = random_panel(6, hole=0.7)
    p = complete_grid(panel(rows)).repartition(4)
    spec = PANEL.with_(block_span=span)
    spec = spec.measured(p) if measured else spec
    got = as_dict(interpolate(p, ["rpn", "rpw"], spec, maxgap=3, by=by), "rpn", "rpw")
    want = {}
    for (s, a), cells in grid(rows).items():
        xs = [y for y, _ in cells] if by == "time" else list(range(len(cells)))
        rpn = by_hand(xs, [v[0] if v else None for _, v in cells], 3)
        rpw = by_hand(xs, [v[2] if v else None for _, v in cells], 3)
        want.update({(s, a, y): (n, w) for (y, _), n, w in zip(cells, rpn, rpw)})
    assert_same(got, want)


@pytest.mark.parametrize("gap,filled", [(20, True), (21, False)])
@pytest.mark.parametrize("span", [1024, 6])
def test_maximum_gap(panel, gap, filled, span):
    years = range(1, gap + 3)
    rows = [("s", y, "B", 1, 1) for y in years] + [("s", 1, "A", 10, 1), ("s", gap + 2, "A", 31, 1)]
    got = as_dict(fill_linear(panel(rows), PANEL.with_(block_span=span)), "rpn")
    assert (got["s", "A", 2] is not None) == filled


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("measured", [False, True])
@pytest.mark.parametrize("by", ["position", "time"])
def test_linear_fill(panel, span, measured, by):
    rows = random_panel(7, hole=0.6)
    p = panel(rows)
    spec = PANEL.with_(block_span=span)
    spec = spec.measured(p) if measured else spec
    got = as_dict(fill_linear(p, spec, start=0, maxgap=4, by=by), "rpn", "rpn_var")
    want = {}
    for (s, a), cells in grid(rows).items():
        cells = [(y, v or [None] * 4) for y, v in cells if y >= 0]
        xs = [y for y, _ in cells] if by == "time" else list(range(len(cells)))
        cv = lambda v: None if v[0] is None or v[1] is None else math.sqrt(v[1]) / v[0]
        value = by_hand(xs, [v[0] for _, v in cells], 4)
        cvs = by_hand(xs, [cv(v) for _, v in cells], 4)
        for (y, v), x, c in zip(cells, value, cvs):
            var = v[1] if v[1] is not None else None if x is None or c is None else (c * x) ** 2
            want[s, a, y] = (x, var)
    assert_same(got, want)


def test_single_value_and_empty_area_are_left_alone(panel):
    rows = [("s", y, "B", 1, 1) for y in (1, 2, 3)] + [("s", 2, "A", 7, 1), ("s", 2, "E", None)]
    for span in SPANS:
        got = as_dict(fill_linear(panel(rows), PANEL.with_(block_span=span)), "rpn")
        assert [got["s", "A", y] for y in (1, 2, 3)] == [None, 7.0, None]
        assert [got["s", "E", y] for y in (1, 2, 3)] == [None] * 3


@pytest.mark.parametrize("span", SPANS)
def test_longterm_share_fill(panel, span):
    spec = PANEL.with_(block_span=span)
    rows = [("s", 1, "A", 10), ("s", 2, "B", 30), ("s", 3, "A", 20), ("s", 6, "B", 60), ("s", 2, "X", 9)]
    p = panel(rows)
    shares = longterm_shares(p, spec, pair=("A", "B"), measure="rpn", mean_start=2).first()
    assert (shares.mean_a, shares.mean_b) == (20.0, 45.0)
    got = as_dict(fill_ltmean(p, spec, pair=("A", "B"), measure="rpn", mean_start=2, start=2), "rpn")
    a, b = 20 / 65, 45 / 65
    want = {2: (30 / b - 30, 30), 3: (20, 20 / a - 20), 4: (None, None), 5: (None, None), 6: (60 / b - 60, 60)}
    assert_same(got, {("s", k, y): float(v) if v is not None else None for y, ab in want.items() for k, v in zip("AB", ab)})


def test_equal_means_count_once_in_the_total(panel):
    p = panel([("s", 1, "A", 10), ("s", 2, "B", 10)])
    literal = longterm_shares(p, pair=("A", "B"), measure="rpn").first()
    intended = longterm_shares(p, pair=("A", "B"), measure="rpn", dedup=False).first()
    assert (literal.share_a, intended.share_a) == (1.0, 0.5)


def test_both_areas_in_one_time_come_out_twice(panel):
    p = panel([("s", 1, "A", 10), ("s", 1, "B", 20), ("s", 2, "B", 30)])
    out = fill_ltmean(p, pair=("A", "B"), measure="rpn")
    assert out.where("year = 1").count() == 4 and out.where("year = 2").count() == 2
    assert [r.year for r in check_alternating(p, ("A", "B")).collect()] == [1]


def test_fills_keep_observed_values_and_species_are_independent(panel):
    rows = random_panel(8)
    p = panel(rows)
    fills = [
        lambda q: fill_ratio(q, targets=["A", "B"], start=-5),
        lambda q: fill_linear(q, start=-5),
    ]
    for fill in fills:
        together = as_dict(fill(p), "rpn", "rpn_var")
        for s, y, a, v, *_ in rows:
            assert v is None or together[s, a, y][0] == v
        alone = as_dict(fill(p.where(F.col("species") == "s1")), "rpn", "rpn_var")
        assert_same({k: v for k, v in together.items() if k[0] == "s1"}, alone)


@pytest.mark.parametrize("span", [1024, 4])
def test_several_methods_on_one_grid(panel, span):
    rows = [
        ("s", y, a, 10.0 + y % 7 + k, (0.1 + 0.01 * k) * y % 3 + 0.5, 5.0 + k, 0.3)
        for y in range(1990, 2006)
        for k, a in enumerate(("A", "B", "C", "D"))
        if not (a == "A" and y % 2) and not (a == "B" and y < 1999 and y != 1993) and not (a == "D" and y in (1996, 1997))
    ]
    p = panel(rows)
    spec = PANEL.measured(p) if span == 1024 else PANEL.with_(block_span=span)
    options = dict(targets=["A", "B"], start=1995)
    for maxgap in (1, 20):
        got = fill_several(p, spec, references={"t": None, "n": "C"}, maxgap=maxgap, **options)
        apart = [
            fill_ratio(p, spec, label="t", **options),
            fill_ratio(p, spec, reference="C", label="n", **options),
            fill_linear(p, spec, start=1995, maxgap=maxgap),
        ]
        want = apart[0].unionByName(apart[1]).unionByName(apart[2])
        key = ("method", "strata", "year")
        values = ("rpn", "rpn_var", "rpw", "rpw_var")
        got, want = as_dict(got, *values, key=key), as_dict(want, *values, key=key)
        assert got.keys() == want.keys() and len(got) == 3 * 4 * 11
        for k in want:
            assert got[k] == pytest.approx(want[k]), k


def test_share_fill_refuses_repeated_cells(panel):
    p = panel([("s", 1, "A", 10), ("s", 1, "A", 30), ("s", 2, "B", 5)])
    with pytest.raises(Exception, match="repeated cell: s, 1"):
        fill_ltmean(p, pair=("A", "B")).collect()


def test_linear_fill_of_blocks_keeps_rows_of_unknown_areas_once(spark):
    rows = [("a", y, area, float(y), 1.0) for y in (0, 1, 4, 9, 12, 13) for area in ("x", None) if (y + len(area or "")) % 3]
    rows += [(None, 3, "x", 2.0, None)]
    df = spark.createDataFrame(rows, "species string, year int, strata string, rpn double, rpn_var double")
    spec = PANEL.with_(measures=("rpn",), block_span=4)
    out = fill_linear(df, spec).collect()
    cells = {(r.species, r.strata, r.year) for r in out}
    grid = {r[1] for r in rows if r[0] == "a"}
    assert len(out) == len(cells) == 2 * len(grid) + 1
    given = {(r[0], r[2], r[1]): r[3] for r in rows}
    # only areas that are known are filled
    assert all(r.rpn == given.get((r.species, r.strata, r.year)) for r in out if r.strata is None or r.species is None)
    assert all(r.rpn is not None for r in out if r.strata == "x" and r.species == "a")


def test_linear_fill_of_blocks_makes_cells_where_they_are_filled(spark, panel):
    spec = PANEL.with_(block_span=4)
    df = panel([("a", y, s, 1.0 + y, 1.0) for y in range(12) for s in ("x", "y") if (y + len(s)) % 3])
    plan = fill_linear(df, spec)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "MapInArrow" in plan
    again = df.unionByName(df.where("year = 6 and strata = 'x'"))
    with pytest.raises(Exception, match="repeated cell: a, x, 6"):
        fill_linear(again, spec).collect()
