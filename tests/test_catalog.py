"""Every catalog query beside its SQL counterpart, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracle import TABLES, rows_of, same
from gapweave.plans import catalog

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = entry_points.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name not in entry_points.oracle_sql():
        # parameters are free on a ridge: their queries have no SQL, their objective has
        assert name in ("ar1_mle_fit", "ar1_fill_mle", "compare_methods_mle")
        return
    result = db.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    assert sorted(names) == sorted(df.columns) and len(got) == len(want)
    off = [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))]
    assert not off, off[:3]


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["species", "method", "year", "rpn", "rpw"] and df.count() == 30


def test_first_values_of_the_segment_index(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("larger tables not present")
    rows = entry_points.queries()["segment_index"](spark, folder).where("species = 'AUTOMOBILE' and year < 1999")
    got = {r.year: r.rpn for r in rows.collect()}
    assert got == pytest.approx({1996: 444.7865, 1997: 477.7891, 1998: 419.0446}, abs=1e-4)
