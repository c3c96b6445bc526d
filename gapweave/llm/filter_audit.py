"""How filters overlap, and what each removes wherever it stands in their order.

Spark counts the documents of every part by the set of filters they fail, a table of at most
2^k rows a part for k filters. That is a contingency tensor with one axis of length two per
filter; one ``einsum`` a part takes pass, fail or both along each axis for every step of every
order. The documents themselves are read once, whatever the number of orders.

Defined results: null texts are empty, null parts are the empty string; a document without id
has no label and never fails the filter for copies, nor makes another fail it; every row of a
repeated id counts as a document, and rows that share both id and text don't make each other
fail. A document whose label is repeated has the larger one. Ties don't occur: all orders are
listed. Tables without rows give no rows. Further columns of the inputs are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gapweave.llm.columns import let, words_of

FEWEST_WORDS = 200
LEAST_DISTINCT = 50  # percent of words
MOST_CAPITALS = 3  # percent of code points
MARKS = "[#$%&*|]"
MOST_FILTERS = 8  # their orders are listed, 40,320 at most

#: Which half of an axis a selection takes: documents that pass, that fail, or all.
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)

AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long,"
    " unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions on a text: few words (A), repetitive words (B), capitals (C), marks (D)."""
    body = F.coalesce(text, F.lit(""))
    sizes = let(words_of(body), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))
    few = sizes["all"] < FEWEST_WORDS
    repetitive = 100 * sizes["distinct"] < LEAST_DISTINCT * sizes["all"]
    capitals = 100 * F.length(F.regexp_replace(body, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(body)
    return {"A": few, "B": repetitive, "C": capitals, "D": body.rlike(MARKS)}


def failure_counts(
    docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column], part: Column, *, copies: bool = True
) -> DataFrame:
    """``(part, fails, n, good, toxic)``: documents by the bits of the conditions they fail.

    Condition ``i`` is bit ``i``; with ``copies`` the next bit says that a smaller ``doc_id``
    has the same text. Copies are told by the SHA-256 of the text. Rows of a text are
    aggregated before they meet, and what meets per text is one row for each part and label,
    so a text with any number of copies is no burden.
    """
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))
    rows = docs.select(
        "doc_id",
        F.coalesce(part, F.lit("")).alias("part"),
        bits.alias("fails"),
        (F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)) if copies else F.lit(b"")).alias("body"),
    )
    rows = rows.groupBy("doc_id", "part", "fails", "body").agg(F.count(F.lit(1)).alias("n"))
    # rows without id find no label: they get keys of their own, so that they don't all meet
    rows = rows.withColumn("apart", F.when(F.col("doc_id").isNull(), F.xxhash64("body")).otherwise(0))
    marks = (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
        .withColumn("apart", F.lit(0).cast("long"))
    )
    known = rows.join(marks, ["doc_id", "apart"], "left").select(
        "doc_id", "part", "fails", "body", "n",
        F.coalesce(F.col("good") == 1, F.lit(False)).alias("good"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
    )
    kind = ["part", "fails", "good", "toxic"]
    if copies:
        own = known.groupBy("body", *kind, "doc_id").agg(F.sum("n").alias("n"))
        # per text, part and label: all rows, those of the smallest id, and those without one
        met = own.groupBy("body", *kind).agg(
            F.sum("n").alias("n"),
            F.min("doc_id").alias("low"),
            F.min_by("n", "doc_id").alias("n_low"),
            F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        )
        low = F.min("low").over(Window.partitionBy("body"))
        first = F.when(F.col("low") == F.col("low_of_all"), F.col("n_low")).otherwise(0)
        met = met.withColumn("low_of_all", low).withColumn("unique", first + F.col("n_null"))
        sides = F.array(
            F.struct(F.col("fails").alias("fails"), F.col("unique").alias("n")),
            F.struct((F.col("fails") + (1 << len(conditions))).alias("fails"), (F.col("n") - F.col("unique")).alias("n")),
        )
        known = met.select("part", "good", "toxic", F.explode(sides).alias("side")).select(
            "part", "good", "toxic", "side.fails", "side.n"
        )
    return known.groupBy("part", "fails").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def selections(k: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders of ``k`` filters, and what each of their steps selects along each axis.

    The array has the shape (orders, steps, 4, axes, 2); the four selections are of the
    documents kept, removed, failing the step's filter, and failing it alone.
    """
    orders = list(itertools.permutations(range(k)))
    take = np.empty((len(orders), k, 4, k, 2), np.int64)
    for o, order in enumerate(orders):
        for step, axis in enumerate(order):
            kept, removed, fails = [ALL] * k, [ALL] * k, [ALL] * k
            for earlier in order[:step]:
                kept[earlier] = removed[earlier] = PASS
            kept[axis], removed[axis], fails[axis] = PASS, FAIL, FAIL
            alone = [PASS] * k
            alone[axis] = FAIL
            take[o, step] = kept, removed, fails, alone
    return orders, take


def contract(tensor: np.ndarray, take: np.ndarray) -> np.ndarray:
    """What every selection counts: ``tensor`` is (measures, 2, ..., 2), the result (..., measures)."""
    k = tensor.ndim - 1
    flat = take.reshape(-1, k, 2)
    operands: list = [tensor, [0, *range(2, k + 2)]]
    for axis in range(k):
        operands += [flat[:, axis], [1, axis + 2]]
    return np.einsum(*operands, [1, 0]).reshape(*take.shape[:-2], -1)


def audit(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row per part, order of the filters and step; ``counts`` as ``failure_counts`` gives them.

    ``removed`` is what the step's filter removes after the earlier ones, ``redundant`` what
    fails it but went earlier, ``unique_fails`` what fails no other, and ``shapley`` the
    filter's ``removed`` over all orders. Lost labels are those of the removed documents.
    """
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters have too many orders; at most {MOST_FILTERS}")
    names, k = list(names), len(names)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tensor = np.zeros((3, 1 << k), np.int64)
        tensor[:, rows["fails"].to_numpy(np.int64)] = rows[["n", "good", "toxic"]].to_numpy(np.int64).T
        # the lowest bit is the first filter's, so the axes come in reverse
        tensor = tensor.reshape(3, *[2] * k).transpose(0, *range(k, 0, -1))
        orders, take = selections(k)
        found = contract(tensor, take)
        axis = np.array(orders)
        kept, removed, fails, alone = (found[:, :, i, 0] for i in range(4))
        shapley = np.zeros(k, np.int64)
        np.add.at(shapley, axis, removed)
        return pd.DataFrame(
            {
                "part": rows["part"].iloc[0],
                "filter_order": np.repeat(["".join(names[i] for i in o) for o in orders], k),
                "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)),
                "kept": kept.ravel(),
                "removed": removed.ravel(),
                "redundant": (fails - removed).ravel(),
                "unique_fails": alone.ravel(),
                "good_lost": found[:, :, 1, 1].ravel(),
                "toxic_lost": found[:, :, 1, 2].ravel(),
                "shapley": shapley[axis].ravel(),
            }
        )

    return counts.groupBy("part").applyInPandas(run, AUDIT)


def audit_text_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters on ``documents (doc_id, text, lang)``, by language: A to D on the text, E for copies."""
    conditions = text_conditions(F.col("text"))
    return audit(failure_counts(docs, labels, conditions, F.col("lang")), [*conditions, "E"])
