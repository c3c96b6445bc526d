"""The estimate, its errors and the whole flow on a small panel made here."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import dense_model, grid
from conftest import as_dict
from gapweave.operators.ar1 import ar1_fit, ar1_predict, ar1_series, fill_ar1
from gapweave.operators.grid import complete_grid, pivot_area
from gapweave.operators.index import total_index
from gapweave.operators.ratio import fill_ratio
from gapweave.operators.project import drop_like, select_like
from gapweave.operators.stack import compare_external
from gapweave.plans.survey_index import compare_methods, share_and_linear_index
from gapweave.sources.panel_io import read_panel_csv, write_panel_csv
from gapweave.spec import PANEL, Schedule
from gapweave.storage import materialize

PAIR = ("A", "B")
SCHEDULE = Schedule({"A": (2, 0), "B": (2, 1)}, always_like="^G")


def value(area, year):
    """Levels around 1, so that the model with mean zero has an inner optimum."""
    return math.exp(math.sin(1.3 * year + {"A": 0.0, "B": 2.0, "G1": 4.0, "G2": 5.0}[area]) + 0.1 * math.cos(7 * year))


def made(years=range(2000, 2016)):
    rows = []
    for y in years:
        for a in ("A", "B", "G1", "G2"):
            if (a == "A" and y % 2) or (a == "B" and not y % 2):
                continue
            v = value(a, y)
            rows.append(("s", y, a, v, (0.1 * v) ** 2, 2 * v, (0.3 * v) ** 2))
    return rows


def objective(rows, x, y, with_se=False):
    total, parts = 0.0, {}
    for (_, a), cells in grid(rows).items():
        if a not in PAIR:
            continue
        ys = [math.log(v[0]) if v else None for _, v in cells]
        rs = [math.log(v[1] / v[0] ** 2 + 1) if v else None for _, v in cells]
        nll, mean, var = dense_model(ys, rs, math.exp(x), -1 + 2 / (1 + math.exp(-y)))
        total += nll
        for (t, _), m, s in zip(cells, mean, var):
            parts[a, t] = (m, s)
    return parts if with_se else total


def best_point(rows):
    """Zoom into the lowest point of ever finer grids."""
    x, y, step = 0.0, 1.0, 2.0
    while step > 1e-7:
        around = [(objective(rows, x + i * step, y + j * step), x + i * step, y + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        low = min(around)
        if low[1:] == (x, y):
            step /= 2
        _, x, y = low
    return x, y


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def best(rows):
    return best_point(rows)


@pytest.fixture(scope="module")
def covariance(rows, best):
    x, y, h = *best, 1e-4
    f = lambda i, j: objective(rows, x + i * h, y + j * h)
    hxx = (f(1, 0) - 2 * f(0, 0) + f(-1, 0)) / h**2
    hyy = (f(0, 1) - 2 * f(0, 0) + f(0, -1)) / h**2
    hxy = (f(1, 1) - f(1, -1) - f(-1, 1) + f(-1, -1)) / (4 * h * h)
    return np.linalg.inv(np.array([[hxx, hxy], [hxy, hyy]]))


@pytest.fixture(scope="module", params=[(1024, True)])
def case(request, panel, rows):
    span, measured = request.param
    p = materialize(panel(rows))
    spec = PANEL.with_(block_span=span)
    return p, spec.measured(p) if measured else spec


@pytest.fixture(scope="module")
def fit(case):
    p, spec = case
    return materialize(ar1_fit(materialize(ar1_series(p, spec, areas=PAIR)), spec))


def test_estimate_and_its_errors(fit, rows, best, covariance):
    got = fit.where("measure = 'rpn'").first()
    assert got.converged and (got.log_pe, got.logit_rho) == pytest.approx(best, abs=1e-4)
    assert got.nll == pytest.approx(objective(rows, *best), rel=1e-9)
    assert (got.log_pe_se, got.logit_rho_se) == pytest.approx(tuple(np.sqrt(np.diag(covariance))), rel=1e-3)


def test_total_error_of_predictions(case, fit, rows, best, covariance):
    p, spec = case
    got = as_dict(
        ar1_predict(ar1_series(p, spec, areas=PAIR), fit, spec, total_se=True).where("measure = 'rpn'"),
        "log_pred", "log_se", key=("strata", "year"),
    )
    h = 1e-4
    at = lambda i, j: objective(rows, best[0] + i * h, best[1] + j * h, with_se=True)
    mid, sides = at(0, 0), [(at(1, 0), at(-1, 0)), (at(0, 1), at(0, -1))]
    for k, (mean, var) in mid.items():
        slope = np.array([(hi[k][0] - lo[k][0]) / (2 * h) for hi, lo in sides])
        assert got[k] == pytest.approx((mean, math.sqrt(var + slope @ covariance @ slope)), abs=2e-4)


def test_total_error_at_every_block_length(panel, rows):
    p = materialize(panel(rows))
    given = ar1_series(p).select("species", "measure").distinct().withColumns(
        {n: F.lit(v) for n, v in (("log_pe", 0.1), ("logit_rho", 1.5), ("cov_pe", 0.04), ("cov_rho", 0.2), ("cov_both", 0.01))}
    )
    found = []
    for spec in (PANEL.measured(p), PANEL.with_(block_span=3)):
        out = ar1_predict(ar1_series(p, spec, areas=PAIR), given, spec, total_se=True)
        found.append(as_dict(out, "log_pred", "log_se", key=("measure", "strata", "year")))
    assert len(found[0]) == 64 and found[0].keys() == found[1].keys()
    for k, v in found[0].items():
        assert found[1][k] == pytest.approx(v, rel=1e-7)


def test_fill_with_estimated_parameters(case, rows, best):
    p, spec = case
    got = as_dict(fill_ar1(p, spec, targets=PAIR), "rpn")
    mid = objective(rows, *best, with_se=True)
    seen = {(s, a, y): v for s, y, a, v, *_ in rows}
    assert len(got) == 16 * 4
    for (s, a, y), v in got.items():
        want = seen.get((s, a, y)) or math.exp(mid[a, y][0])
        assert v == pytest.approx(want, rel=1e-3)


def test_whole_flow(case, rows, best):
    p, spec = case
    out = compare_methods(p, spec, targets=PAIR, neighbour="G1", schedule=SCHEDULE, start=2001)
    got = as_dict(out.totals, "rpn", key=("method", "year"))
    mid = objective(rows, *best, with_se=True)
    seen = {(a, y): v for _, y, a, v, *_ in rows}
    for y in range(2001, 2016):
        want = sum(seen.get((a, y)) or math.exp(mid[a, y][0]) for a in ("A", "B", "G1", "G2"))
        assert got["ar1", y] == pytest.approx(want, rel=1e-3)
    assert {m for m, _ in got} == {"total_ratio", "neighbour_ratio", "linear", "ar1"} and out.scores.count() == 8


def test_index_beside_an_older_panel(case, panel, rows):
    p, spec = case
    old = panel([(s, y, a, v * (2 if a == "A" else 1), *w) for s, y, a, v, *w in rows])
    out = share_and_linear_index(p, spec, pair=PAIR, mean_start=2000, start=2001, older=old)
    got = as_dict(out, "rpn", key=("method", "year"))
    assert {m for m, _ in got} == {"ltmean", "ltmean_older", "linear"}
    mean = {a: np.mean([v for _, _, b, v, *_ in rows if b == a]) for a in PAIR}
    for name, a_mean in (("ltmean", mean["A"]), ("ltmean_older", 2 * mean["A"])):
        share = a_mean / (a_mean + mean["B"])
        values = old if name == "ltmean_older" else None
        v = value("A", 2002) * (2 if values is not None else 1)
        assert got[name, 2002] == pytest.approx(v / share)


def test_repeated_cells_are_refused(panel):
    p = panel([("s", 1, "A", 10, 1), ("s", 1, "A", 4, 8), ("s", 2, "A", 5)])
    for act in (
        lambda: complete_grid(p).collect(),
        lambda: pivot_area(p, "rpn", ["A"]).collect(),
        lambda: fill_ar1(p, targets=["A"], params=(0.0, 1.0)).collect(),
    ):
        with pytest.raises(Exception, match="repeated cell"):
            act()


def test_parameters_must_cover_every_series(panel, spark):
    p = panel([("s", 1, "A", 5, 1), ("t", 1, "A", 7, 1)])
    params = spark.createDataFrame([("s", "rpn", 0.0, 1.0), ("t", "rpn", 0.0, 1.0), ("s", "rpw", 0.0, 1.0)], "species string, measure string, log_pe double, logit_rho double")
    with pytest.raises(Exception, match="no parameters for: t, rpw|no parameters for: rpw, t"):
        ar1_predict(ar1_series(p), params).collect()


def test_groups_without_observations_have_no_estimate(panel):
    p = panel([("s", y, "A", value("A", y), 0.01) for y in range(2000, 2012)])
    got = {r.measure: r for r in ar1_fit(materialize(ar1_series(p)), PANEL.measured(p)).collect()}
    assert got["rpw"].log_pe is None and got["rpw"].nll is None and not got["rpw"].converged
    assert got["rpn"].converged and got["rpn"].log_pe is not None


def test_no_errors_on_a_flat_ridge(panel):
    p = panel([("s", y, "A", 1000 + 0.001 * y, 1.0) for y in range(2000, 2030)])
    got = ar1_fit(materialize(ar1_series(p)), PANEL.measured(p)).where("measure = 'rpn'").first()
    assert got.converged and (got.logit_rho_se is None or got.logit_rho_se < 100)


def test_other_methods_are_scored_apart(panel):
    obs = panel([("s", y, "A", v) for y, v in ((1, 10), (2, 20), (3, 40))])
    one, two = (panel([("s", y, "A", v) for y in (1, 2, 3)]) for v in (15, 30))
    external = one.withColumn("method", F.lit("x")).union(one.withColumn("method", F.lit("y"))).union(two.withColumn("method", F.lit("z")))
    out = compare_external(obs.withColumnRenamed("rpn", "obs"), external, two, relabel=("x", "a", "b"))
    got = as_dict(out, "mean_pdiff", key=("method",))
    diff = lambda a, b: 100 * abs(a - b) / ((a + b) / 2)
    assert got["a",] == pytest.approx((diff(20, 15) + diff(40, 15)) / 2)
    assert got["b",] == pytest.approx((diff(20, 15) + diff(40, 15) + diff(20, 30) + diff(40, 30)) / 4)


def test_csv_files_of_different_column_order(spark, panel, tmp_path):
    p = panel(made(range(2000, 2004)))
    write_panel_csv(p.where("strata = 'A'"), f"{tmp_path}/a")
    write_panel_csv(p.where("strata != 'A'").select(*reversed(p.columns)), f"{tmp_path}/b")
    back = read_panel_csv(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, p.collect()))


def test_projection_by_name(panel):
    p = panel([("s", 1, "A", 1)])
    assert select_like(p, "RPN", keep=["year"]).columns == ["year", "rpn", "rpn_var"]
    assert drop_like(p, "_VAR", "Rpw").columns == [c for c in p.columns if "var" not in c and "rpw" not in c]


# Survey indices of some years as published, with the totals published beside them,
# and cells that two of the areas lack, filled from the total of the other three.
PUBLISHED = [
    ("s", 1996, "AI", 57517, 8270513.223, 163925, 67178514.06),
    ("s", 1998, "AI", 98842.2276127975, 98790853.0451977, 301003.874949765, 903277122.857582),
    ("s", 2022, "AI", 407632.617179076, 756223550.22889, 863338.438847994, 3397767845.59522),
    ("s", 1995, "BS", 54024.17, 7296527.36, 169458.08, 71790102.19),
    ("s", 1997, "BS", 42959.5606141973, 23585964.5995389, 156848.110248464, 314130156.08718),
    ("s", 2021, "BS", 405576.197908769, 698648130.916462, 915848.684447859, 3361144180.74272),
    ("s", 2023, "BS", 442355.955525492, 2427627557.83167, 962495.760236742, 11213091712.7836),
    ("s", 1995, "CG", 153683.786906392, 143719833.6506, 557624.005581848, 1688633886.62484),
    ("s", 1996, "CG", 180251.3646209, 196606456.79541, 733880.413579052, 3169463534.91516),
    ("s", 1997, "CG", 164673.726467585, 214396850.513641, 636699.24259278, 3131112471.91945),
    ("s", 1998, "CG", 128441.440055802, 154525898.574929, 484677.898287203, 2248025209.74345),
    ("s", 2021, "CG", 232724.773031101, 426679127.345616, 560908.086842196, 2470265560.57152),
    ("s", 2022, "CG", 267640.478578969, 341397365.095918, 672326.905989675, 2145872544.87164),
    ("s", 2023, "CG", 295720.957067924, 1029397209.3707, 703293.482211924, 5988584458.94638),
    ("s", 1995, "EG", 164910.984805079, 93460620.8356982, 639088.667414303, 1490821203.15773),
    ("s", 1996, "EG", 154843.490463385, 46216248.2487091, 648799.588530097, 792587371.759071),
    ("s", 1997, "EG", 152334.982041317, 76010986.9025699, 586740.118198854, 1126312046.14672),
    ("s", 1998, "EG", 144882.647642931, 86424823.9818459, 557827.214940817, 1421043085.38073),
    ("s", 2021, "EG", 168332.722279292, 90852306.8222594, 452433.654582381, 698077010.391322),
    ("s", 2022, "EG", 209235.494379624, 109366188.77166, 565568.879308238, 818815859.133372),
    ("s", 2023, "EG", 223329.323172325, 246376246.004504, 557779.673206876, 1550475028.25414),
    ("s", 1995, "WG", 58461.573839089, 35045955.7206184, 187575.372565793, 360785053.814619),
    ("s", 1996, "WG", 58454.070694653, 41944300.7006177, 199883.285966659, 490451873.681383),
    ("s", 1997, "WG", 62329.9831830612, 22242853.7989302, 172471.488230462, 170306455.195111),
    ("s", 1998, "WG", 64317.630077073, 57354197.1188038, 195805.648899631, 531564012.783664),
    ("s", 2021, "WG", 133654.053120818, 154844034.360686, 297883.130738417, 769169456.734655),
    ("s", 2022, "WG", 153910.783240489, 85095407.1723653, 361681.113711763, 469915409.632728),
    ("s", 2023, "WG", 138086.289268083, 298141383.930096, 286882.156317041, 1286850862.14793),
]
PUBLISHED_TOTALS = {1998: (474721.383747383, 1678454.39881515), 2022: (1516868.16510711, 3580168.70128311), 2023: (1524153.15248083, 3345927.83027528)}
FILLED = {
    ("AI", 1997): (55440.1806, 144591.1754),
    ("AI", 2023): (424660.6274, 835476.7583),
    ("BS", 1996): (56387.2066, 193730.0095),
    ("BS", 2022): (478448.7917, 1117253.3634),
}


def test_published_totals(panel):
    """The ratio fill and the strict total give what was published."""
    p = panel(PUBLISHED)
    spec = PANEL.measured(p)
    filled = fill_ratio(p, spec, targets=["AI", "BS"], start=1996, label="ratio")
    cells = as_dict(filled, "rpn", "rpw", key=("strata", "year"))
    for k, want in FILLED.items():
        assert cells[k] == pytest.approx(want, abs=1e-4)
    totals = as_dict(total_index(filled, spec), "rpn", "rpw", key=("year",))
    for year, want in PUBLISHED_TOTALS.items():
        assert totals[(year,)] == pytest.approx(want, rel=1e-9)
