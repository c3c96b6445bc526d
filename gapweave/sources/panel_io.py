"""Reading and writing panels: database, CSV and Parquet."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gapweave.spec import PANEL, PanelSpec

MISSING = "NA"


def jdbc_options(
    url: str,
    query: str,
    *,
    time: str = PANEL.time,
    bounds: tuple[int, int] | None = None,
    partitions: int | None = None,
    options: dict[str, str] | None = None,
) -> dict[str, str]:
    """Options of a JDBC read of ``query``.

    With ``bounds`` (first and last time) the read is split into one range of times
    per partition; otherwise the query runs once and gives one partition.
    """
    out = {"url": url, **(options or {})}
    if bounds is None:
        return {**out, "query": query}
    first, last = bounds
    return {
        **out,
        "dbtable": f"({query}) panel_extract",
        "partitionColumn": time,
        "lowerBound": str(first),
        "upperBound": str(last + 1),
        "numPartitions": str(partitions or last - first + 1),
    }


def read_jdbc_panel(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """Rows of a query that the database runs, with lower-case column names."""
    df = spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()
    return lower_names(df)


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower() for c in df.columns))


def read_panel_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    spec: PanelSpec = PANEL,
    *,
    infer: bool = False,
) -> DataFrame:
    """Panel from CSV with headers; columns are found by name, in each file's own order.

    Values spelled ``NA`` and empty ones are missing. With ``infer`` all columns are read, in
    the order in which the files name them first, with the types of :func:`infer_csv_schema`;
    a column that a file lacks is missing there. Otherwise the columns are those of
    ``schema``, by default the panel's, and a file that lacks one is an error.
    """
    paths = [path] if isinstance(path, str) else list(path)
    files = headers(spark, paths)
    if infer:
        schema = _inferred(spark, files)
    schema = spec.schema() if schema is None else schema
    types = {f.name: f.dataType for f in schema.fields}
    parts = []
    for names, some in files.items():
        unknown = sorted(set(types) - set(names))
        if unknown and not infer:
            raise ValueError(f"columns missing from {some[:3]}: {unknown}")
        stored = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
        df = _csv(spark, some, stored)
        parts.append(df.select(*(F.lit(None).cast(types[n]).alias(n) if n in unknown else n for n in types)))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def _csv(spark: SparkSession, files: Sequence[str], stored: T.StructType) -> DataFrame:
    return spark.read.csv(files, header=True, schema=stored, nullValue=MISSING, mode="FAILFAST")


# Narrowest types of a value, one bit each. A column's bits are those of all its values.
_WHOLE, _LONG, _REAL, _TRUTH, _DATE, _MOMENT, _TEXT = (1 << i for i in range(7))


def _kind(value: Column) -> Column:
    """The bit of a value's narrowest type; missing values have none."""
    number = value.rlike(r"^[+-]?\d+$")
    real = value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(Infinity|Inf)$|^NaN$")
    date = value.rlike(r"^\d{4}-\d{2}-\d{2}$") & value.try_cast("date").isNotNull()
    moment = value.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}") & value.try_cast("timestamp").isNotNull()
    return (
        F.when(value.isNull(), 0)
        .when(number & value.try_cast("int").isNotNull(), _WHOLE)
        .when(number & value.try_cast("bigint").isNotNull(), _LONG)
        .when(number | real, _REAL)
        .when(F.lower(value).isin("true", "false"), _TRUTH)
        .when(date, _DATE)
        .when(moment, _MOMENT)
        .otherwise(_TEXT)
    )


def _join(bits: int) -> T.DataType:
    """The narrowest type that holds all values with these bits; text where none does."""
    for within, kind in (
        (_WHOLE, T.IntegerType()),
        (_WHOLE | _LONG, T.LongType()),
        (_WHOLE | _LONG | _REAL, T.DoubleType()),
        (_TRUTH, T.BooleanType()),
        (_DATE, T.DateType()),
        (_DATE | _MOMENT, T.TimestampType()),
    ):
        if bits and not bits & ~within:
            return kind
    return T.StringType()


def _inferred(spark: SparkSession, files: dict[tuple[str, ...], list[str]]) -> T.StructType:
    found: dict[str, int] = {}
    for names, some in files.items():
        stored = T.StructType([T.StructField(n, T.StringType()) for n in names])
        kinds = (F.bit_or(_kind(F.col(f"`{n}`"))).alias(f"c{i}") for i, n in enumerate(names))
        bits = _csv(spark, some, stored).agg(*kinds).first()
        for n, b in zip(names, bits):
            found[n] = found.get(n, 0) | (b or 0)
    return T.StructType([T.StructField(n, _join(b)) for n, b in found.items()])


def infer_csv_schema(spark: SparkSession, path: str | Sequence[str]) -> T.StructType:
    """Columns of CSV files with headers and the narrowest types that hold all their values.

    Every value of every file counts: its narrowest type is a bit, a column's bits are
    combined by *or*, in each task and then across tasks and files, and the bits give the type.
    Whole numbers become ``int`` or, if one needs it, ``bigint``; a column that mixes whole and
    decimal spellings, or has numbers beyond ``bigint``, is ``double``; then there are
    ``boolean``, ``date`` and ``timestamp``. Mixtures of other kinds, numbers with blanks
    around them and columns without any value are ``string``.
    """
    return _inferred(spark, headers(spark, [path] if isinstance(path, str) else list(path)))


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by the columns of their header lines.

    A header is the first line of the part of a file that begins at byte 0. The lines of a part
    arrive in order, so a task hands on the first it sees of each; nothing is sorted or
    shuffled. One line per file comes to the driver, beside the file list that Spark holds
    there anyway.
    """
    lines = spark.read.text(list(paths)).select("_metadata.file_path", "_metadata.file_block_start", "value")

    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            path = pc.run_end_encode(batch.column(0))  # a part's lines follow each other
            begins = pa.array([0, *path.run_ends.to_pylist()[:-1]], pa.int32())
            new = [i for i, p in zip(begins.to_pylist(), path.values.to_pylist()) if p != seen]
            seen = path.values[-1].as_py()
            if new:
                yield pa.RecordBatch.from_arrays([c.take(pa.array(new, pa.int32())) for c in (batch.column(0), batch.column(2))], names=["file_path", "line"])

    found: dict[tuple[str, ...], list[str]] = {}
    first = lines.where("file_block_start = 0").mapInArrow(first_lines, "file_path string, line string")
    for r in sorted(first.collect()):
        names = tuple(next(csv.reader([r.line.removeprefix("\ufeff")])))
        found.setdefault(names, []).append(r.file_path)
    return found


def write_panel_csv(df: DataFrame, path: str) -> None:
    """Replace the CSV data set at ``path`` (a folder of part files with headers)."""
    df.write.mode("overwrite").csv(path, header=True, nullValue=MISSING)


def write_panel_table(
    df: DataFrame, name: str, spec: PanelSpec = PANEL, *, buckets: int, path: str | None = None
) -> None:
    """Replace the table ``name`` by the panel, stored by series in ``buckets`` buckets.

    Rows are dealt by key and area as the buckets are, so each task writes one file, sorted by
    series and time. Choose buckets so that one fits into a task's memory; a series lies in one
    of them. With ``path`` the files are kept there, else in the warehouse.
    """
    out = df.repartition(buckets, *spec.series).write.format("parquet").mode("overwrite")
    out = out.bucketBy(buckets, *spec.series).sortBy(*spec.series, spec.time)
    (out if path is None else out.option("path", path)).saveAsTable(name)


def read_panel_table(
    spark: SparkSession, name: str, spec: PanelSpec = PANEL
) -> tuple[DataFrame, PanelSpec]:
    """A table written by :func:`write_panel_table`, and its layout with buckets and extent.

    Fills by this layout add to the rows where they are stored, without a shuffle of them.
    """
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    by = [c.strip("`") for c in told.get("Bucket Columns", "[]").strip("[]").split(", ")]
    if by != spec.series:
        raise ValueError(f"{name} is not stored by {spec.series} but by {by}")
    table = spark.table(name)
    return table, spec.with_(buckets=int(told["Num Buckets"])).measured(table)


def write_panel_parquet(
    df: DataFrame, path: str, spec: PanelSpec = PANEL, partition_by: Sequence[str] = ()
) -> None:
    """Replace the Parquet data set at ``path``, clustered by series for pruning.

    Rows are range-partitioned and sorted by key, area and time, so that a filter on
    the key reads few row groups however many keys there are. ``partition_by`` adds
    folders; use it only for columns with few values.
    """
    order = [*spec.keys, spec.area, spec.time] if spec.area in df.columns else [*spec.keys, spec.time]
    out = df.repartitionByRange(*partition_by, *order).sortWithinPartitions(*partition_by, *order)
    out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
