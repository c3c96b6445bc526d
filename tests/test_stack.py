import pytest
from pyspark.sql import functions as F

from conftest import as_dict
from gapweave.operators.index import index_with_ci, reconcile, total_index
from gapweave.operators.stack import compare_external, score_methods, stack_methods
from gapweave.spec import PANEL, Schedule

SCHEDULE = Schedule({"A": (2, 0), "B": (2, 1)}, always_like="^G")
KEY = ("species", "strata", "year", "method")


def filled(panel, label, shift=0.0):
    rows = [("s", y, a, 10.0 * y + i + shift, 1.0, y, 1.0) for y in range(1, 7) for i, a in enumerate("ABG")]
    return panel(rows).withColumn("method", F.lit(label))


def test_stack_marks_survey_values_like_a_self_join(panel):
    bare = filled(panel, "y", 3).drop("rpn_var")
    out = stack_methods(
        [filled(panel, "x"), bare], schedule=SCHEDULE, areas=["B", "A"], methods=["y", "x"]
    ).cache()
    assert out.where("method = 'y' and rpn_var is not null").isEmpty()
    seen = out.where(SCHEDULE.surveyed("strata", "year")).select(*KEY, F.col("rpn").alias("joined"))
    both = out.join(seen, list(KEY), "left")
    assert both.where("not (obs_rpn <=> joined)").isEmpty()
    orders = {(r.strata, r.area_order, r.method, r.method_order) for r in out.collect()}
    assert ("A", 2, "x", 2) in orders and ("B", 1, "y", 1) in orders and ("G", None, "x", 2) in orders


@pytest.mark.parametrize("span", [1024, 2, 1])
@pytest.mark.parametrize("measured", [False, True])
def test_scores(panel, span, measured):
    stacked = stack_methods([filled(panel, "x"), filled(panel, "y", 50)], schedule=SCHEDULE)
    spec = PANEL.with_(block_span=span)
    spec = spec.measured(stacked) if measured else spec
    got = as_dict(score_methods(stacked, spec, targets=["A", "B"], ranked=True), "rpn_stat", "score_rank", key=("strata", "method"))
    for i, area in enumerate("AB"):
        for label, shift, rank in (("x", 0, 1), ("y", 50, 1)):
            diffs = []
            for y in range(1, 6):
                if (y + 1) % 2 == i:
                    now, ahead = 10.0 * y + i + shift, 10.0 * (y + 1) + i + shift
                    diffs.append(100 * abs(ahead - now) / ((ahead + now) / 2))
            assert got[area, label][0] == pytest.approx(sum(diffs) / len(diffs))
        assert got[area, "y"][1] == 1 and got[area, "x"][1] == 2


def test_total_is_missing_if_an_area_is(panel):
    p = panel([("s", 1, "A", 1), ("s", 1, "B", 2), ("s", 2, "A", 1), ("s", 2, "B", None)])
    out = as_dict(total_index(p.withColumn("method", F.lit("m"))), "rpn", key=("year",))
    assert out == {(1,): 3.0, (2,): None}


def test_index_falls_back_on_a_fixed_cv(panel):
    p = panel([("s", 1, "A", 100), ("s", 1, "B", 100), ("s", 2, "A", 10, 4), ("s", 2, "B", None), ("s", 3, "A", 5, 0)])
    p = p.withColumn("method", F.lit("m"))
    out = as_dict(index_with_ci(p), "rpn", "rpn_var", "lci", "uci", key=("year",))
    assert out[1,] == pytest.approx((200, 1600, 200 - 1.96 * 40, 200 + 1.96 * 40))
    assert out[2,] == pytest.approx((10, 4, 10 - 3.92, 10 + 3.92))
    assert out[3,][1] == pytest.approx(1.0)
    scaled = as_dict(index_with_ci(p, scale=1000), "rpn", "rpn_var", "uci", key=("year",))
    assert scaled[1,] == pytest.approx((0.2, 1600, 0.2 + 1.96 * 0.04))


def test_reconcile(panel):
    p = panel([("s", 1, "A", 11, 1, 5, 1), ("s", 2, "A", 3)])
    known = panel([("s", 1, "A", 10, 1, 5, 1), ("s", 3, "A", 8)]).drop("strata")
    out = as_dict(reconcile(total_index(p, group=()), known), "rpn_rel_diff", "rpw_rel_diff", key=("year",))
    assert out[1,] == pytest.approx((0.1, 0.0)) and out[2,] == (None, None) and out[3,] == (None, None)


@pytest.mark.parametrize("span", [1024, 1])
def test_compare_external(panel, span):
    spec = PANEL.with_(block_span=span)
    obs = panel([("s", 1, "A", 10), ("s", 2, "A", 20), ("s", 3, "A", None), ("s", 4, "A", 40)])
    external = panel([("s", 1, "A", 12), ("s", 2, "A", 15)])
    external = external.withColumn("method", F.lit("m1")).union(external.withColumn("method", F.lit("m2")))
    external = external.union(external.withColumn("method", F.lit("skip")).limit(0))
    new = panel([("s", y, "A", 20) for y in (1, 2, 3, 4)])
    out = compare_external(
        obs.withColumnRenamed("rpn", "obs"), external, new, spec, exclude=["skip"], relabel=("m1", "a", "b"), label="n"
    )
    got = as_dict(out, "mean_pdiff", key=("method",))
    assert got["a",] == pytest.approx(100 * 8 / 16) and got["b",] == got["a",]
    assert got["n",] == pytest.approx((0.0 + 100 * 20 / 30) / 2)
    assert got[None,] is None
