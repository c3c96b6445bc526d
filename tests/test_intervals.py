import random

import pytest

from gapweave.operators.intervals import join_intervals
from gapweave.spec import PANEL

LEFT = "species string, strata string, year int, rpn double"
SPANS = "species string, strata string, start int, end int, reason string"


def made(seed):
    rng = random.Random(seed)
    series = [(s, a) for s in "st" for a in "AB"]
    left = [(*k, t, float(t)) for k in series for t in range(-20, 30) if rng.random() < 0.7]
    spans = []
    for k in series:
        for i in range(6):
            a = rng.randint(-40, 40)
            b = a + rng.randint(-3, 25)
            spans.append((*k, rng.choice([a, a, None]), rng.choice([b, b, None]), f"r{i}"))
    return left + left[:3], spans + spans[:1] + [("u", "A", -100, 100, "elsewhere")]


@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_every_span_around_a_row(spark, width, how):
    left, spans = made(width)
    out = join_intervals(
        spark.createDataFrame(left, LEFT), spark.createDataFrame(spans, SPANS), columns=["reason"], how=how, width=width
    )
    want = []
    for r in left:
        around = [
            s for s in spans if s[:2] == r[:2] and (s[2] is None or s[2] <= r[2]) and (s[3] is None or s[3] >= r[2])
        ]
        want += [(*r, *s[2:]) for s in around] or ([(*r, None, None, None)] if how == "left" else [])
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_empty_sides_and_wrong_names(spark):
    left, spans = made(0)
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(spans, SPANS)
    assert join_intervals(a.where("false"), b).collect() == []
    assert {r.start for r in join_intervals(a, b.where("false")).collect()} == {None}
    assert join_intervals(a, b.where("false"), how="inner").collect() == []
    with pytest.raises(ValueError, match="how"):
        join_intervals(a, b, how="outer")
    with pytest.raises(ValueError, match="both tables"):
        join_intervals(a.withColumnRenamed("rpn", "end"), b)
