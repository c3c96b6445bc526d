"""A training corpus from ``documents``: five stages, each an operator of ``gapweave.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of
``documents``; further columns of its input are not carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapweave.llm.decontaminate import drop_contaminated
from gapweave.llm.line_dedup import drop_boilerplate
from gapweave.llm.minhash_icws import first_of_classes
from gapweave.llm.mixing import in_training_order, mix_sources
from gapweave.llm.zstd_quality import fit_quality, score_quality
from gapweave.storage import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the compression classifier predicts to be bad."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the boilerplate lines of each source out of the texts."""
    left = drop_boilerplate(docs.select(*COLUMNS), "source")
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of each class; those without an id are kept."""
    return first_of_classes(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item, in whatever order its passages come."""
    return drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, in training order.

    A row per document; ``copies`` and ``positions`` say how often and when it is read, so
    repeats don't repeat the text.
    """
    return in_training_order(mix_sources(docs.select(*COLUMNS)).where("copies > 0"))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: A classifier and near-duplicates can't be put in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
