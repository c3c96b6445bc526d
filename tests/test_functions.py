import math

import pytest
from pyspark.sql import functions as F

from gapweave.functions import (
    ci,
    cv,
    genlogit,
    geninvlogit,
    log_positive,
    log_sd,
    normal_limits,
    percent_difference,
    strict_sum,
    sum0,
    total_of_distinct,
    var_from_cv,
    z_value,
)
from gapweave.spec import PANEL, Schedule


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_cv_and_variance(spark):
    r = one(spark, cv(F.lit(4.0), F.lit(9.0)), cv(F.lit(0.0), F.lit(9.0)), var_from_cv(F.lit(0.5), F.lit(6.0)))
    assert r == (0.75, None, 9.0)


def test_logs_need_a_positive_value(spark):
    r = one(spark, log_positive(F.lit(0.0)), log_positive(F.lit(math.e)), log_sd(F.lit(0.0), F.lit(0.3)))
    assert r[0] is None and r[1] == pytest.approx(1.0) and r[2] is None
    assert one(spark, log_sd(F.lit(2.0), F.lit(0.3)))[0] == pytest.approx(math.sqrt(math.log(1.09)))


@pytest.mark.parametrize("low,upp,x", [(0, 1, 0.2), (-1, 1, 0.5), (2, 7, 6.5)])
def test_logit_round_trip(spark, low, upp, x):
    r = one(spark, genlogit(F.lit(x), low, upp), geninvlogit(genlogit(F.lit(x), low, upp), low, upp))
    p = (x - low) / (upp - low)
    assert r[0] == pytest.approx(math.log(p / (1 - p))) and r[1] == pytest.approx(x)


def test_logit_limits(spark):
    r = one(spark, genlogit(F.lit(0.0)), genlogit(F.lit(1.0)), geninvlogit(F.lit(1000.0)), geninvlogit(F.lit(-1000.0)))
    assert r == (None, None, 1.0, 0.0)


def test_intervals(spark):
    z = z_value()
    assert z == pytest.approx(1.959963984540054, abs=1e-12)
    i, e, x, p90 = one(
        spark,
        ci(F.lit(1.0), F.lit(0.5)),
        ci(F.lit(1.0), F.lit(0.5), type="exp"),
        ci(F.lit(1.0), F.lit(0.5), lo=-1, hi=1, type="expit", k=2),
        ci(F.lit(1.0), F.lit(0.5), p=0.9),
    )
    assert tuple(i) == pytest.approx((1.0, 0.5, 1 - z * 0.5, 1 + z * 0.5))
    assert tuple(e) == pytest.approx((math.e, math.e * 0.5, math.exp(1 - z * 0.5), math.exp(1 + z * 0.5)))
    p = 1 / (1 + math.exp(-2))
    assert x["est"] == pytest.approx(-1 + 2 / (1 + math.exp(-1)))
    assert x["se"] == pytest.approx(2 * 2 * p * (1 - p) * 0.5)
    assert x["lci"] == pytest.approx(-1 + 2 / (1 + math.exp(-(1 - z * 0.5))))
    assert p90["uci"] == pytest.approx(1 + 1.2815515655446004 * 0.5)
    with pytest.raises(ValueError):
        ci(F.lit(1.0), F.lit(1.0), type="other")


def test_percent_difference_and_limits(spark):
    low, upp = normal_limits(F.lit(10.0), F.lit(4.0))
    r = one(spark, percent_difference(F.lit(8.0), F.lit(12.0)), percent_difference(F.lit(0.0), F.lit(0.0)), low, upp)
    assert r[0] == pytest.approx(40.0) and r[1] is None
    assert r[2:] == pytest.approx((10 - 3.92, 10 + 3.92))


def test_sums_of_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("c", 2.0)], "k string, x double")
    out = {r.k: (r.s, r.t) for r in df.groupBy("k").agg(sum0("x").alias("s"), strict_sum("x").alias("t")).collect()}
    assert out == {"a": (1.0, None), "b": (0.0, None), "c": (2.0, 2.0)}


def test_equal_values_count_once(spark):
    r = one(
        spark,
        total_of_distinct(F.lit(3.0), F.lit(3.0)),
        total_of_distinct(F.lit(3.0), F.lit(4.0)),
        total_of_distinct(F.lit(None).cast("double"), F.lit(4.0)),
    )
    assert r == (3.0, 7.0, 4.0)


def test_schedule(spark):
    df = spark.createDataFrame(
        [(a, y) for a in ("E", "O", "West Gulf", "X") for y in (-3, -2, 4, 5)], "area string, year int"
    )
    periodic = {"E": (2, 0), "O": (2, 1)}
    seen = lambda s: {tuple(r) for r in df.where(s.surveyed("area", "year")).collect()}
    base = {("E", -2), ("E", 4), ("O", -3), ("O", 5)}
    gulf = {("West Gulf", y) for y in (-3, -2, 4, 5)}
    assert seen(Schedule(periodic, always_like="Gulf")) == base | gulf
    assert seen(Schedule(periodic, always=("West Gulf",))) == base | gulf
    assert seen(Schedule(periodic)) == base | gulf | {("X", y) for y in (-3, -2, 4, 5)}
    assert seen(Schedule({"X": (3, 1)}, always=("none",))) == {("X", -2), ("X", 4)}


def test_extent_is_checked(spark, panel):
    p = panel([("s", 2000, "A", 1), ("s", 2005, "A", 2)])
    spec = PANEL.measured(p)
    assert spec.extent == (2000, 2005) and spec.one_block
    assert not PANEL.with_(block_span=5).measured(p).one_block
    assert PANEL.measured(p.where("false")) == PANEL
    with pytest.raises(Exception, match="outside the declared extent"):
        p.select(spec.with_(extent=(2001, 2005)).block()).collect()
