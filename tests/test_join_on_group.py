"""Rows joined to a table with one row per group."""

import pytest

from gapweave.operators import blocks


def _tables(spark):
    sizes = {f"g{i}": 1 for i in range(40)} | {"large": 500}
    rows = [(k, i) for k, n in sizes.items() for i in range(n)] + [(None, 0), ("lost", 0)]
    rows = spark.createDataFrame(rows, "k string, i int")
    groups = spark.createDataFrame([(k, n) for k, n in sizes.items()] + [(None, -1), ("unused", 0)], "k string, n int")
    return sizes, rows, groups


def test_each_row_meets_its_group_once(spark):
    sizes, rows, groups = _tables(spark)
    got = sorted((r.k, r.i, r.n) for r in blocks.join_on_group(rows, groups, ["k"], ["i"]).collect())
    assert got == sorted((k, i, n) for k, n in sizes.items() for i in range(n))


def test_stored_subgroups_give_the_same_rows(spark):
    _, rows, groups = _tables(spark)
    plain = blocks.join_on_group(rows, groups, ["k"], ["i"])
    left = blocks.salted(rows, ["i"])
    given = blocks.join_on_group(left, groups, ["k"], ["i"], used=blocks.subgroups(left, ["k"]))
    assert given.columns == plain.columns and sorted(given.collect()) == sorted(plain.collect())


def test_rows_without_a_group_are_refused(spark):
    _, rows, groups = _tables(spark)
    with pytest.raises(Exception, match="no group for: lost"):
        blocks.join_on_group(rows.where("k = 'lost'"), groups, ["k"], ["i"], missing="no group for").collect()


def test_groups_are_copied_to_used_subgroups_only(spark):
    # A copy per shuffle partition would be 8 times the table, a size that Spark does not
    # know when it chooses what to broadcast.
    _, rows, groups = _tables(spark)
    out = blocks.join_on_group(rows, groups, ["k"], ["i"])
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    used = blocks.subgroups(blocks.salted(rows, ["i"]), ["k"])
    assert used.join(groups, "k").count() <= 40 + 8
