import random

import pytest

from gapweave.operators.asof import DIRECTIONS, join_asof
from gapweave.spec import PANEL

LEFT = "species string, strata string, year int, rpn double, note string"
RIGHT = "species string, strata string, year int, ext double, other double"


def by_hand(left, right, direction, tolerance):
    out = []
    for s, a, t, v, note in left:
        order = lambda r: tuple((x is not None, x or 0) for x in r[3:])
        mine = [r for r in right if r[:2] == (s, a)]
        before, after = [r for r in mine if r[2] <= t], [r for r in mine if r[2] >= t]
        p = max(before, key=lambda r: (r[2], order(r)), default=None)
        q = max(after, key=lambda r: (-r[2], order(r)), default=None)
        if direction == "nearest":
            best = p if q is None or (p is not None and t - p[2] <= q[2] - t) else q
        else:
            best = p if direction == "backward" else q
        if best is not None and tolerance is not None and abs(best[2] - t) > tolerance:
            best = None
        out.append((s, a, t, v, note, *(best[2:] if best else (None,) * 3)))
    return sorted(out, key=repr)


def rows(seed):
    rng = random.Random(seed)
    series = [(s, a) for s in "st" for a in "AB"]
    left = [(*k, t, float(t), f"n{t}") for k in series for t in range(-30, 40) if rng.random() < 0.5]
    left += left[:5] + [("u", "A", 3, 1.0, "alone")]
    right = [(*k, t, rng.choice([None, 1.0, 2.0]), float(t)) for k in series for t in range(-40, 50, 3) if rng.random() < 0.4]
    right += [(*r[:3], 5.0, None) for r in right[::4]] + [("v", "B", 1, 1.0, 1.0)]
    return left, right


@pytest.mark.parametrize("span, measured", [(1024, True), (1024, False), (7, True), (1, False)])
@pytest.mark.parametrize("direction", DIRECTIONS)
def test_nearest_in_time(spark, span, measured, direction):
    left, right = rows(span)
    a, b = spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT).repartition(3)
    spec = PANEL.with_(block_span=span)
    spec = spec.measured(a, b) if measured else spec
    for tolerance in (None, 4):
        out = join_asof(a, b, spec, columns=["ext", "other"], direction=direction, tolerance=tolerance)
        assert out.columns == [*a.columns, "matched_time", "ext", "other"]
        assert sorted(map(tuple, out.collect()), key=repr) == by_hand(left, right, direction, tolerance)


def test_empty_sides_and_wrong_names(spark):
    left, right = rows(1)
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    assert join_asof(a.where("false"), b, columns=["ext"]).collect() == []
    assert {r.ext for r in join_asof(a, b.where("false"), columns=["ext"]).collect()} == {None}
    with pytest.raises(ValueError, match="direction"):
        join_asof(a, b, columns=["ext"], direction="sideways")
    with pytest.raises(ValueError, match="both tables"):
        join_asof(a, b.withColumnRenamed("ext", "rpn"), columns=["rpn"])
