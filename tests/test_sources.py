import os

import pytest
from pyspark.sql import functions as F

from brute import random_panel
from gapweave.operators.linear import fill_linear
from gapweave.operators.ratio import fill_ratio
from gapweave.sources.extract import extract_alternating, extract_total
from gapweave.sources.panel_io import (
    headers,
    infer_csv_schema,
    jdbc_options,
    read_panel_csv,
    read_panel_table,
    write_panel_csv,
    write_panel_parquet,
    write_panel_table,
)
from gapweave.spec import PANEL, Schedule
from gapweave.storage import materialize, work_folder

ROWS = [("s", 1996, "A", 1.5, 2.0, None, 4.0), ("s", 1997, "B", 3.0, None, 5.0, 6.0), ("t", 1997, "B", 1.0)]


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_csv_round_trip(spark, panel, tmp_path):
    p = panel(ROWS)
    path = str(tmp_path / "panel")
    write_panel_csv(p, path)
    write_panel_csv(p, path)
    back = read_panel_csv(spark, path)
    assert back.dtypes == p.dtypes and sorted_rows(back) == sorted_rows(p)
    text = "".join(open(os.path.join(path, f)).read() for f in os.listdir(path) if f.startswith("part"))
    assert "NA" in text and "species,year,strata,rpn" in text


def test_csv_columns_in_any_order(spark, tmp_path):
    file = tmp_path / "p.csv"
    file.write_text("strata,rpw_var,rpw,year,species,rpn_var,rpn,note\nA,NA,,1999,s,2,10,x\n")
    row = read_panel_csv(spark, str(file)).first()
    assert row.asDict() == dict(species="s", year=1999, strata="A", rpn=10.0, rpn_var=2.0, rpw=None, rpw_var=None)
    with pytest.raises(ValueError, match="obs"):
        read_panel_csv(spark, str(file), PANEL.with_(measures=("obs",)).schema())


def test_parquet_prunes_by_key(spark, panel, tmp_path):
    path = str(tmp_path / "panel")
    write_panel_parquet(panel(ROWS), path)
    back = spark.read.parquet(path)
    assert sorted_rows(back.select(panel(ROWS).columns)) == sorted_rows(panel(ROWS))
    plan = back.where("species = 's'").select("rpn")._jdf.queryExecution().toString()
    assert "EqualTo(species,s)" in plan


def test_jdbc_options():
    one = jdbc_options("jdbc:x", "select 1", options={"user": "u"})
    assert one == {"url": "jdbc:x", "user": "u", "query": "select 1"}
    many = jdbc_options("jdbc:x", "select 1", bounds=(1996, 2023), partitions=7)
    assert many["dbtable"] == "(select 1) panel_extract" and "query" not in many
    assert (many["partitionColumn"], many["lowerBound"], many["upperBound"], many["numPartitions"]) == ("year", "1996", "2024", "7")


def raw(spark):
    rows = [
        (c, code, "S" + code, y, a, 1.0, 2.0, 3.0, 4.0)
        for c in ("US", "CA")
        for code in ("1", "2")
        for y in (1994, 1995, 1996, 1997)
        for a in ("E", "O", "G", "X")
    ]
    names = "COUNTRY SPECIES_CODE SPECIES YEAR COUNCIL_MANAGEMENT_AREA RPN RPN_VAR RPW RPW_VAR".split()
    return spark.createDataFrame(rows, names).withColumn("YEAR", F.col("YEAR").cast("int"))


def test_extract_alternating(spark):
    out = extract_alternating(
        raw(spark),
        schedule=Schedule({"E": (2, 0), "O": (2, 1)}, always=("G",)),
        start=1995,
        equal={"country": "US"},
        codes=["2"],
    )
    got = [(r.species, r.strata, r.year) for r in out.collect()]
    want = [("S2", "E", 1996), ("S2", "G", 1995), ("S2", "G", 1996), ("S2", "G", 1997), ("S2", "O", 1995), ("S2", "O", 1997)]
    assert got == want and out.columns == PANEL.schema().fieldNames()


def test_extract_total(spark):
    out = extract_total(raw(spark).where("COUNCIL_MANAGEMENT_AREA = 'E'"), start=1996, equal={"country": "CA"}, codes=["1", "2"])
    assert [(r.year, r.species) for r in out.collect()] == [(1996, "S1"), (1996, "S2"), (1997, "S1"), (1997, "S2")]


def test_materialize_uses_the_configured_folder(spark, panel):
    folder = work_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    table = materialize(panel(ROWS))
    assert all(folder in f for f in table.inputFiles()) and sorted_rows(table) == sorted_rows(panel(ROWS))


def test_types_of_all_files_count(spark, tmp_path):
    """One value decides, wherever it is; columns may come in any order or be absent."""
    (tmp_path / "a.csv").write_text(
        "n,big,x,flag,day,at,text,none,odd\n"
        + "1,2,3,true,2020-01-31,2020-01-31 10:00:00,a,NA,1\n" * 500
        + "-7,3000000000,4.5,FALSE,2020-02-01,2020-02-01,1,,true\n"
    )
    (tmp_path / "b.csv").write_text("x,n,later,big,huge\n.5,+3,007,1,12345678901234567890\n1e-3,NA,8,2,1\n")
    (tmp_path / "c.csv").write_text("x,n\n")
    found = {f.name: f.dataType.simpleString() for f in infer_csv_schema(spark, str(tmp_path))}
    assert found == {
        "n": "int", "big": "bigint", "x": "double", "flag": "boolean", "day": "date", "at": "timestamp",
        "text": "string", "none": "string", "odd": "string", "later": "int", "huge": "double",
    }
    back = read_panel_csv(spark, str(tmp_path), infer=True)
    assert dict(back.dtypes) == found and back.count() == 503
    rows = back.where("later is not null").orderBy("later").collect()
    assert [(r.x, r.n, r.later, r.big, r.flag, r.huge) for r in rows] == [
        (0.5, 3, 7, 1, None, 12345678901234567890.0), (0.001, None, 8, 2, None, 1.0)
    ]


def test_no_type_fits_all(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c,d\n1,2020-01-01, 5,2020-02-30\n")
    (tmp_path / "b.csv").write_text("a,b,c,d\n2020-01-01,7,5,2020-01-01\n")
    assert {f.dataType.simpleString() for f in infer_csv_schema(spark, str(tmp_path))} == {"string"}


def test_headers_are_first_lines(spark, tmp_path):
    """Of every file, also of long ones in several parts and of those without further lines."""
    for i in range(12):
        names = "b,a" if i % 3 else "a,b"
        (tmp_path / f"f{i}.csv").write_text(f"{names}\n" + "9,8\n" * (0 if i == 5 else 3000 if i == 7 else 2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = headers(spark, [str(tmp_path)])
        plan = read_panel_csv(spark, str(tmp_path), infer=True)
        assert plan.count() == 3000 + 10 * 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    names = {k: sorted(int(f.rsplit("/f", 1)[1].split(".")[0]) for f in v) for k, v in found.items()}
    assert names == {("a", "b"): [0, 3, 6, 9], ("b", "a"): [1, 2, 4, 5, 7, 8, 10, 11]}


@pytest.mark.parametrize("span", [1024, 5])
def test_fills_of_a_panel_stored_by_series(spark, panel, tmp_path, span):
    """The same values, and no row of the panel is shuffled for the linear fill."""
    p = panel(random_panel(6, species=4))
    name = f"stored_{span}"
    write_panel_table(p, name, buckets=3, path=str(tmp_path / name))
    table, spec = read_panel_table(spark, name, PANEL.with_(block_span=span))
    assert spec.buckets == 3 and spec.extent is not None and sorted_rows(table.select(p.columns)) == sorted_rows(p)
    plain = PANEL.with_(block_span=span).measured(p)
    for fill, options in ((fill_linear, {}), (fill_ratio, {"targets": ["A", "B"], "start": -99})):
        got, want = fill(table, spec, **options), fill(p, plain, **options)
        assert sorted_rows(got.select(want.columns)) == sorted_rows(want)
    plan = fill_linear(table, spec)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    shuffles = [x for x in plan.split("\n\n") if ") Exchange" in x]
    # nothing but keys, times and, with several blocks, one row per block
    assert shuffles and not any("rpn_var" in x for x in shuffles)
    if span == 1024:
        assert not any("rpn" in x for x in shuffles)
    spark.sql(f"DROP TABLE {name}")


def test_tables_by_other_columns_are_refused(spark, panel, tmp_path):
    panel(ROWS).write.bucketBy(2, "strata").option("path", str(tmp_path / "t")).saveAsTable("by_area")
    with pytest.raises(ValueError, match="not stored by"):
        read_panel_table(spark, "by_area")
    spark.sql("DROP TABLE by_area")
