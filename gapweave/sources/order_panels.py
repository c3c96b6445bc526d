"""Panels derived from the order tables (orders, lineitem, customer, nation, region)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gapweave.spec import Schedule

TARGETS = ("AFRICA", "AMERICA")
NEIGHBOUR = "ASIA"
AREAS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
SCHEDULE = Schedule({"AFRICA": (2, 0), "AMERICA": (2, 1)}, always=AREAS[2:])
START = 1996
# Unit of the value measure, in currency. Being prime to 10 it keeps rounded results
# off decimal ties, where two engines may differ over the last digit of a sum.
UNIT = 977.0


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _orders_with_region(spark: SparkSession, folder: str) -> DataFrame:
    nation = _table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = _table(spark, folder, "region").select("r_regionkey", "r_name")
    customer = _table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return (
        _table(spark, folder, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


def _cells(rows: DataFrame, keys: dict[str, Column], price: str) -> DataFrame:
    """Count and value per cell, with variances; value in units of ``UNIT``.

    Sums are of decimals and so do not depend on the order of addition. The variance
    of a sum is ``n`` times the sample variance of its terms, missing for one term.
    """
    money = F.col(price).cast("decimal(18,2)")
    n, s = F.col("n").cast("double"), F.col("s").cast("double")
    squares = F.col("q").cast("double")
    spread = F.try_divide((squares - s * s / n) * n, n - 1.0)
    return (
        rows.select(*(c.alias(k) for k, c in keys.items()), money.alias("money"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("money").alias("s"),
            F.sum(F.col("money") * F.col("money")).alias("q"),
        )
        .select(
            *keys,
            n.alias("rpn"),
            n.alias("rpn_var"),
            (s / UNIT).alias("rpw"),
            (spread / (UNIT * UNIT)).alias("rpw_var"),
        )
    )


def raw_survey(spark: SparkSession, folder: str) -> DataFrame:
    """Line items per market segment, supplier, year and region, all years and areas."""
    items = _table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    rows = _orders_with_region(spark, folder).join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    keys = {
        "country": F.col("c_mktsegment"),
        "species": F.col("l_suppkey").cast("string"),
        "species_code": F.col("l_suppkey").cast("string"),
        "year": F.year("o_orderdate"),
        "council_management_area": F.col("r_name"),
    }
    return _cells(rows, keys, "l_extendedprice")


def supplier_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Line items per supplier, year and region, in the survey schedule.

    The number of series grows with the tables.
    """
    items = _table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    rows = _orders_with_region(spark, folder).join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    year = F.year("o_orderdate")
    keys = {"species": F.col("l_suppkey").cast("string"), "year": year, "strata": F.col("r_name")}
    return _cells(rows.where(SCHEDULE.surveyed("r_name", year)), keys, "l_extendedprice")


def segment_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per market segment, year and region, in the survey schedule."""
    rows, year = _orders_with_region(spark, folder), F.year("o_orderdate")
    keys = {"species": F.col("c_mktsegment"), "year": year, "strata": F.col("r_name")}
    return _cells(rows.where(SCHEDULE.surveyed("r_name", year)), keys, "o_totalprice")


def daily_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per market segment, day (counted from 1970) and region, in the schedule.

    Few long series with natural gaps; the time column is still called ``year``.
    """
    rows, day = _orders_with_region(spark, folder), F.unix_date(F.to_date("o_orderdate"))
    keys = {"species": F.col("c_mktsegment"), "year": day, "strata": F.col("r_name")}
    return _cells(rows.where(SCHEDULE.surveyed("r_name", day)), keys, "o_totalprice")


def supplier_day_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Line items per supplier, day (counted from 1970) and region, in the schedule.

    Many series that each span several blocks of time.
    """
    items = _table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    rows = _orders_with_region(spark, folder).join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    day = F.unix_date(F.to_date("o_orderdate"))
    keys = {"species": F.col("l_suppkey").cast("string"), "year": day, "strata": F.col("r_name")}
    return _cells(rows.where(SCHEDULE.surveyed("r_name", day)), keys, "l_extendedprice")


def supplier_total(spark: SparkSession, folder: str) -> DataFrame:
    """Line items per supplier and year over all regions and years."""
    items = _table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    rows = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    keys = {"species": F.col("l_suppkey").cast("string"), "year": F.year("o_orderdate")}
    return _cells(rows, keys, "l_extendedprice")
