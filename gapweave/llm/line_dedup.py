"""Line dedup by site-relative frequency.

A line is boilerplate of a host if more than ``max_ratio`` of the host's pages contain it,
and at least ``min_pages`` do. Lines are compared trimmed, by a 128-bit hash.

A page has a line once however often it repeats it, so the lines over the ratio are fewer
than a host's mean lines per page divided by the ratio: the list per host is bounded
whatever the number of pages. Counting combines before the shuffle, and the pages of a
host are never brought together: each page is joined to its host's short list, which Spark
broadcasts while it is under the session's limit and otherwise joins with skew handling.

Defined results: a null text stays null and has no lines; lines without a word are kept
and not counted; pages of a null host keep all lines; a page whose every line would go
stays whole (copies of whole pages are near-dedup's business); repeated rows count as
pages. Columns other than the text are kept; ``n_lines`` and ``n_dropped`` are replaced, and
columns with this module's work names (``_host``, ``_lines``, ``_rest``) are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gapweave.storage import materialize

MAX_RATIO, MIN_PAGES = 0.05, 5
WORK = ("_host", "_lines", "_rest")
SPACES = " \t\x0b\x0c\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _hash(line: Column) -> Column:
    return F.unhex(F.md5(_bare(line)))


def boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", *, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``(host, lines)``: hashes of each host's boilerplate lines."""
    bare = F.array_distinct(F.transform(F.split(F.col(text), "\n"), _bare))
    lines = pages.where(F.col(host).isNotNull()).select(
        F.col(host).alias("_host"), F.explode(F.filter(bare, lambda x: F.length(x) > 0)).alias("_line")
    )
    counts = (
        lines.select("_host", F.unhex(F.md5("_line")).alias("_line"))
        .groupBy("_host", "_line")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_pages)
    )
    totals = pages.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("_pages"))
    return (
        counts.join(totals, "_host")
        .where(F.col("_n") > F.col("_pages") * F.lit(float(max_ratio)))
        .groupBy("_host")
        .agg(F.collect_set("_line").alias("_lines"))
    )


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", *, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``pages`` without boilerplate lines, with ``n_lines`` and ``n_dropped``."""
    # stored, the short lists are planned by their true size, and a large host's pages can be split
    found = materialize(boilerplate(pages, host, text, max_ratio=max_ratio, min_pages=min_pages))
    joined = pages.drop("n_lines", "n_dropped", *WORK).join(found, F.col(host) == F.col("_host"), "left")
    left = F.filter(
        F.split(F.col(text), "\n"),
        lambda x: (F.length(_bare(x)) == 0) | ~F.array_contains(F.col("_lines"), _hash(x)),
    )
    rest = F.when(F.col("_lines").isNotNull(), left).otherwise(F.split(F.col(text), "\n"))
    some = F.exists(F.col("_rest"), lambda x: F.length(_bare(x)) > 0)
    total = F.coalesce(F.size(F.split(F.col(text), "\n")), F.lit(0))
    return (
        joined.withColumns({"_rest": rest, "n_lines": F.when(F.col(text).isNull(), 0).otherwise(total)})
        .withColumn("n_dropped", F.when(some, F.col("n_lines") - F.size("_rest")).otherwise(0))
        .withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join("_rest", "\n")).otherwise(F.col(text)))
        .drop("_rest", "_host", "_lines")
    )
