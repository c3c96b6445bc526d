"""Intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or set on the context."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the work folder and read it back.

    Used for tables that a later plan scans several times: each of those scans then
    reads only its own columns, with statistics for the optimizer, instead of
    repeating the joins and aggregations above.
    """
    path = f"{work_folder(df.sparkSession).rstrip('/')}/gapweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
