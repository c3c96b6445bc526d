"""The unknown mean of the AR(1) model, and the exact derivatives of its objective."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import gapweave.operators.ar1 as ar1
import gapweave.operators.ar1_slopes as slopes
from brute import grid, random_panel
from conftest import as_dict
from gapweave.operators.ar1 import ar1_filter, ar1_fit, ar1_mean, ar1_predict, ar1_series, fill_ar1
from gapweave.operators.duals import Dual
from gapweave.spec import PANEL

PARAMS = (0.4, 1.5)
PE, RHO = math.exp(PARAMS[0]), -1 + 2 / (1 + math.exp(-PARAMS[1]))
SERIES = ("species", "measure", "strata")


@pytest.fixture(params=[(1024, True), (1024, False), (5, False), (2, False)])
def setting(request, panel, monkeypatch):
    span, measured = request.param
    if not measured:
        monkeypatch.setattr(ar1, "RADIX", 3)
        monkeypatch.setattr(slopes, "CELLS", 4)
    rows = random_panel(21, species=2, hole=0.5)
    rows += [("s2", t, a, None, None) for t in range(4) for a in "AB"]  # nothing observed
    p = panel(rows).repartition(4)
    spec = PANEL.with_(block_span=span)
    return rows, p, spec.measured(p) if measured else spec


def log_series(cells, measure):
    i = {"rpn": 0, "rpw": 2}[measure]
    ys, rs = [], []
    for _, v in cells:
        v = None if v is None else [*v, None, None, None, None]
        ok = v is not None and v[i] is not None and v[i + 1] is not None and v[i] > 0
        ys.append(math.log(v[i]) if ok else None)
        rs.append(math.log(v[i + 1] / v[i] ** 2 + 1) if ok else None)
    return ys, rs


def series_of(rows, measure):
    """``(species, area): (times, values, variances)`` of the areas A and B."""
    return {
        k: ([t for t, _ in cells], *log_series(cells, measure)) for k, cells in grid(rows).items() if k[1] != "C"
    }


def gls(members, pe=PE, rho=RHO):
    """Mean and its information of series ``(times, values, variances)`` that share one."""
    total = info = 0.0
    for _, ys, rs in members:
        at = [k for k, y in enumerate(ys) if y is not None]
        if at:
            cov = pe * pe * np.array([[rho ** abs(i - j) for j in at] for i in at]) + np.diag([rs[k] for k in at])
            y, one = np.array([ys[k] for k in at]), np.ones(len(at))
            total += one @ np.linalg.solve(cov, y)
            info += one @ np.linalg.solve(cov, one)
    return (total / info, info) if info else (None, None)


def kriged(one, mean, info):
    """Prediction and standard error per time around an estimated mean, and the objective at it."""
    times, ys, rs = one
    at = [k for k, y in enumerate(ys) if y is not None]
    cov = lambda a, b: PE * PE * np.array([[RHO ** abs(i - j) for j in b] for i in a])
    inner = cov(at, at) + np.diag([rs[k] for k in at])
    gap = np.array([ys[k] for k in at]) - mean
    out = {}
    for k, t in enumerate(times):
        weights = np.linalg.solve(inner, cov(at, [k]))[:, 0]
        var = PE * PE - weights @ cov(at, [k])[:, 0] + (1 - weights.sum()) ** 2 / info
        out[t] = (mean + weights @ gap, math.sqrt(var))
    nll = 0.5 * (len(at) * math.log(2 * math.pi) + np.linalg.slogdet(inner)[1] + gap @ np.linalg.solve(inner, gap))
    return out, nll


@pytest.mark.parametrize("over", [True, ["species"]])
def test_mean_prediction_and_objective_equal_the_joint_distribution(setting, over):
    rows, p, spec = setting
    series = ar1_series(p, spec, areas=["A", "B"]).cache()
    means = {tuple(r)[:-2]: tuple(r)[-2:] for r in ar1_mean(series, PARAMS, spec, demean=over).collect()}
    pred = as_dict(ar1_predict(series, PARAMS, spec, demean=over), "log_pred", "log_se", key=(*SERIES, "year"))
    filtered = ar1_filter(series, PARAMS, spec, demean=over)
    nll = as_dict(filtered.groupBy(*SERIES).agg(F.sum("nll").alias("nll")), "nll", key=SERIES)
    seen = 0
    for m in ("rpn", "rpw"):
        every = series_of(rows, m)
        for (s, a), one in every.items():
            shares = [one] if over is True else [o for (sp, _), o in every.items() if sp == s]
            mean, info = gls(shares)
            got = means[(s, m, a) if over is True else (s, m)]
            if mean is None:
                assert got == (None, None) and all(pred[s, m, a, t] == (None, None) for t in one[0])
                continue
            assert got == pytest.approx((mean, info**-0.5), rel=1e-9)
            if not any(y is not None for y in one[1]):
                continue
            states, value = kriged(one, mean, info)
            assert nll[s, m, a] == pytest.approx(value, rel=1e-8)
            for t, want in states.items():
                assert pred[s, m, a, t] == pytest.approx(want, rel=1e-8)
                seen += 1
    assert seen > 50


def test_mean_moves_with_the_values(panel):
    """Multiplying all values by a factor moves predictions by its logarithm, and no error."""
    rows = random_panel(4, species=1, hole=0.4)
    scaled = [(*r[:3], *(None if v is None else v * f for v, f in zip(r[3:], (50, 2500, 50, 2500)))) for r in rows]
    out = []
    for some in (rows, scaled):
        p = panel(some)
        spec = PANEL.measured(p)
        out.append(as_dict(ar1_predict(ar1_series(p, spec), PARAMS, spec, demean=True), "log_pred", "log_se", key=(*SERIES, "year")))
    for k, (mean, se) in out[0].items():
        assert out[1][k] == (None, None) if mean is None else out[1][k] == pytest.approx((mean + math.log(50), se), rel=1e-9)


def test_means_are_of_series_or_coarser(panel):
    p = panel(random_panel(4, species=1))
    series = ar1_series(p)
    with pytest.raises(ValueError, match="coarser"):
        ar1_mean(series, PARAMS, demean=["nowhere"])
    with pytest.raises(ValueError, match="can't share"):
        ar1_fit(series, group=["species", "strata"], method="grid", demean=["species"])


def test_nothing_observed_at_all(panel):
    p = panel([("s", t, a, None, None) for t in range(3) for a in "AB"])
    series = ar1_series(p)
    assert all(r["mean"] is None for r in ar1_mean(series, PARAMS).collect())
    fit = ar1_fit(series, method="mle", demean=True).collect()
    assert fit and all(not r.converged and r.log_pe is None for r in fit)
    none = ar1_series(p.where("false"))
    assert ar1_predict(none, PARAMS, demean=True).collect() == [] and ar1_fit(none).collect() == []


# derivatives


def test_duals_follow_the_calculus():
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0.5, 2.0, (2, 30))
    dx, dy = Dual(x, x=np.ones(30)), Dual(y, y=np.ones(30))
    got = (dx * dy * dy + dx * 3.0 - dy).inverse() * dx.log()
    h = 1e-4

    def f(a, b):
        return np.log(a) / (a * b * b + 3 * a - b)

    want = (
        f(x, y),
        (f(x + h, y) - f(x - h, y)) / (2 * h),
        (f(x, y + h) - f(x, y - h)) / (2 * h),
        (f(x + h, y) - 2 * f(x, y) + f(x - h, y)) / h**2,
        (f(x + h, y + h) - f(x + h, y - h) - f(x - h, y + h) + f(x - h, y - h)) / (4 * h * h),
        (f(x, y + h) - 2 * f(x, y) + f(x, y - h)) / h**2,
    )
    for a, b in zip(got.parts, want):
        assert np.allclose(a, b, rtol=1e-5, atol=1e-6)


@pytest.mark.parametrize("demean", [False, True, ["species"]])
def test_slopes_are_those_of_the_objective(setting, spark, demean):
    rows, p, spec = setting
    series = ar1_series(p.where("species <> 's2'"), spec, areas=["A", "B"]).cache()
    group, (x, y), h = ["species", "measure"], PARAMS, 1e-3
    blank = {n: None for n in ar1.STATE} | {"damp": 1.0, "try_x": x, "try_y": y, "done": False}
    state = spark.createDataFrame(
        [(s, m, *blank.values()) for s in ("s0", "s1") for m in ("rpn", "rpw")],
        "species string, measure string, " + ", ".join(f"{n} {'boolean' if n == 'done' else 'double'}" for n in blank),
    )
    got = as_dict(ar1._slopes_at(series, state, group, spec, demean), *ar1.DERIVATIVES, key=group)
    points = [(x + i * h, y + j * h) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    plain = series.withColumn("_cands", ar1._candidates(points))
    values = as_dict(ar1._objective(plain, group, ar1._series_key(series), spec, demean), "nll", key=(*group, "k"))
    assert len(got) == 4
    for k, found in got.items():
        f = lambda i, j: values[(*k, 3 * (i + 1) + j + 1)]
        want = (
            f(0, 0),
            (f(1, 0) - f(-1, 0)) / (2 * h),
            (f(0, 1) - f(0, -1)) / (2 * h),
            (f(1, 0) - 2 * f(0, 0) + f(-1, 0)) / h**2,
            (f(1, 1) - f(1, -1) - f(-1, 1) + f(-1, -1)) / (4 * h * h),
            (f(0, 1) - 2 * f(0, 0) + f(0, -1)) / h**2,
        )
        assert found[0] == pytest.approx(want[0], rel=1e-10)
        assert found == pytest.approx(want, rel=1e-4, abs=2e-4)


@pytest.mark.parametrize("demean", [True, ["species"]])
def test_likelihood_fit_with_means_is_a_minimum(panel, demean):
    rows = random_panel(12, species=1, hole=0.3)
    p = panel(rows)
    spec = PANEL.measured(p)
    series = ar1_series(p, spec, areas=["A", "B"]).cache()
    fit = ar1_fit(series, spec, demean=demean).where("measure = 'rpn'").first()
    assert fit.converged
    at = (fit.log_pe, fit.logit_rho)
    near = [at] + [(at[0] + dx, at[1] + dy) for dx, dy in np.random.default_rng(0).normal(0, 0.3, (30, 2))]
    plain = series.where("measure = 'rpn'").withColumn("_cands", ar1._candidates(near))
    found = ar1._objective(plain, ["species"], ar1._series_key(series), spec, demean).collect()
    values = [r.nll for r in sorted(found, key=lambda r: r.k)]
    assert values[0] == pytest.approx(fit.nll, rel=1e-9) and min(values) >= fit.nll - 1e-8


def test_fill_with_a_mean_keeps_observations(panel):
    rows = random_panel(11, species=2, hole=0.5)
    p = panel(rows)
    spec = PANEL.measured(p)
    got = as_dict(fill_ar1(p, spec, targets=["A", "B"], params=PARAMS, demean=True), "rpn", "rpn_var")
    pred = as_dict(ar1_predict(ar1_series(p, spec, areas=["A", "B"]), PARAMS, spec, demean=True), "pred", key=(*SERIES, "year"))
    for (s, a), cells in grid(rows).items():
        for t, v in cells:
            if a != "C" and (v is None or v[0] is None):
                assert got[s, a, t][0] == pytest.approx(pred[s, "rpn", a, t]) and got[s, a, t][1] is None
            elif v is not None:
                assert got[s, a, t] == (v[0], v[1])
