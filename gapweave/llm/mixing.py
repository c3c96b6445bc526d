"""Mixing sources to target weights with a time-varying curriculum.

Every source has a weight schedule over training time 0..1, piecewise linear between
knots. Its integral is the source's weight, and the weights share out the demand, at most
``max_epochs`` times what a source has. The cumulative demand of a source up to a time is
the integral of its schedule, scaled to its target; inverting it at a document's place in
its source's stream gives the document's position in training.

Documents of a source are ordered by a hash of their id. The running size within a source
comes from two levels: sums per hash bucket, and a window inside each bucket. Both the
number of buckets and the rows in one grow with the square root of the rows, so a source
with a third of all rows is spread like any other.

Defined results: a null text has size 0; a null source is a source of its own, the last;
documents of size 0 and sources without words get ``taken`` 0 and no position; repeated
rows count each; an empty table gives an empty result. Further columns are kept, except
those with the names this operator adds, which are replaced, and its work names, which are
dropped (``WORK``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapweave.llm.columns import words_of
from gapweave.storage import materialize

ADDED = ("size", "source_size", "target", "taken", "copies", "positions")
WORK = ("_key", "_site", "_bucket", "_sum", "_in", "_start", "_middle", "_whole", "_rank")
FLAT = ((0.0, 1.0), (1.0, 1.0))
#: Weight over time of every first, second and third source, each with mean 1.
CURRICULUM = (((0.0, 1.5), (1.0, 0.5)), FLAT, ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))


def word_count(text: Column) -> Column:
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("long")


def area(knots: Sequence[tuple[float, float]]) -> float:
    """Integral of a piecewise linear schedule."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """Target words of each source from ``(source, source_size)``.

    Weights go round the sources in code point order, null last. A source whose share
    would exceed ``max_epochs`` times its size gets that much, and the rest is shared by
    weight again. Taken in the order of size per weight, the sources that end at their
    limit come first, so running sums find them without iteration. One row per source
    meets in one task here, nothing larger.
    """
    all_rows = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("_rank", F.row_number().over(all_rows) - 1).withColumn(
        "weight", F.get(cycle, F.col("_rank") % len(weights))
    )
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("_rank"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    limit = F.col("source_size") * F.lit(float(max_epochs))
    filled = ranked.select(
        "*",
        (total - F.coalesce(F.sum(limit).over(before), F.lit(0.0))).alias("left"),
        F.sum("weight").over(onwards).alias("open"),
        limit.alias("limit"),
    ).withColumn("full", F.col("limit") * F.col("open") <= F.col("left") * F.col("weight"))
    rest = F.min(F.when(~F.col("full"), F.struct((F.col("open") * -1).alias("minus"), "left"))).over(Window.partitionBy())
    return filled.withColumn("rest", rest).select(
        "source",
        "source_size",
        "_rank",
        F.when(F.col("full"), F.col("limit"))
        .otherwise(F.col("rest.left") * F.col("weight") / (F.col("rest.minus") * -1))
        .alias("target"),
    )


def invert(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which a piecewise linear schedule has given out ``share`` of its integral."""
    whole, gone, out = area(knots), 0.0, None
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        piece = (t1 - t0) * (w0 + w1) / 2
        need = F.greatest(F.lit(0.0), share * whole - gone)
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + need * (2 * slope)))
        at = F.least(F.lit(t1), F.lit(t0) + F.coalesce(F.try_divide(need * 2, root + w0), F.lit(0.0)))
        here = F.when(share * whole <= gone + piece, at)
        out = here if out is None else F.coalesce(out, here)
        gone += piece
    return F.coalesce(out, F.lit(knots[-1][0]))


def _inverter(knots):
    return lambda u: invert(u, knots)


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    curriculum: Sequence[Sequence[tuple[float, float]]] = CURRICULUM,
    max_epochs: float = 3.0,
) -> DataFrame:
    """``docs`` with sizes, targets, words taken, copies and their training positions.

    ``docs`` needs ``doc_id``, ``text`` and ``source``. ``weights`` go round the sources
    and are multiplied by the integral of the source's schedule in ``curriculum``. Whole
    epochs of a source are taken whole; of the last one, those documents whose middle
    lies before the target, so what is taken misses the target by half a document at most.
    """
    kinds = math.lcm(len(weights), len(curriculum))
    scaled = [weights[i % len(weights)] * area(curriculum[i % len(curriculum)]) for i in range(kinds)]
    sized = docs.drop(*ADDED, *WORK).withColumns(
        {
            "size": word_count(F.col("text")),
            "_key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
        }
    )
    narrow = materialize(sized.select("source", "_key", "size"))
    rows = narrow.count()
    width = max(1, math.ceil(math.log2(max(2, rows)) / 8))  # hex digits: about the root of the rows
    bucket = F.substring("_key", 1, width)
    same = lambda a, b: F.coalesce(F.concat(F.lit("="), F.col(a)), F.lit("")).alias(b)
    targets = source_targets(
        narrow.groupBy("source").agg(F.sum("size").alias("source_size")), scaled, max_epochs
    ).select(same("source", "_site"), "source_size", "_rank", "target")
    sums = narrow.groupBy(same("source", "_site"), bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"))
    up_to = Window.partitionBy("_site").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_site", "_bucket", F.coalesce(F.sum("_sum").over(up_to), F.lit(0)).alias("_start"))
    starts = starts.join(targets, "_site")
    inside = (
        Window.partitionBy("_site", "_bucket")
        .orderBy("_key", F.col("doc_id"), "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        sized.withColumns({"_site": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")), "_bucket": bucket})
        .withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, ["_site", "_bucket"])
    )
    middle = F.col("_start") + F.col("_in") + F.col("size") / 2.0
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    placed = placed.withColumns({"_middle": middle, "_whole": whole.cast("int")}).withColumn(
        "copies",
        F.when(F.col("size") == 0, 0).otherwise(
            F.col("_whole")
            + F.when(F.col("_middle") < F.col("target") - F.col("_whole") * F.col("source_size"), 1).otherwise(0)
        ),
    )
    places = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda i: F.least(
        F.lit(1.0), (i * F.col("source_size") + F.col("_middle")) / F.col("target"))))
    timed = F.when(F.lit(False), places)
    for k in range(kinds):
        knots = curriculum[k % len(curriculum)]
        timed = timed.when(F.col("_rank") % kinds == k, F.transform(places, _inverter(knots)))
    return placed.withColumns({"taken": F.col("size") * F.col("copies"), "positions": timed}).drop(*WORK)


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Documents range-sorted by their first training position, those not taken last."""
    return mixed.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")
