"""Fill two alternately surveyed areas by their long-term shares of the total."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gapweave.functions.aggregates import total_of_distinct
from gapweave.operators.blocks import join_on_group
from gapweave.operators.grid import COUNT, time_range
from gapweave.spec import PANEL, PanelSpec


def longterm_shares(
    df: DataFrame,
    spec: PanelSpec = PANEL,
    *,
    pair: tuple[str, str],
    measure: str | None = None,
    mean_start: int | None = None,
    dedup: bool = True,
) -> DataFrame:
    """Long-term mean of each area of the pair and its share of their total.

    One row per key: ``mean_a, mean_b, share_a, share_b``. With ``dedup`` two equal
    means count once in the total, as in a sum over distinct values.
    """
    m = F.col(measure or spec.measures[0])
    counted = F.lit(True) if mean_start is None else F.col(spec.time) >= mean_start
    means = [
        F.avg(F.when(counted & (F.col(spec.area) == area), m)).alias(name)
        for area, name in zip(pair, ("mean_a", "mean_b"))
    ]
    out = df.where(F.col(spec.area).isin(*pair)).groupBy(*spec.keys).agg(*means)
    plain = F.coalesce("mean_a", F.lit(0.0)) + F.coalesce("mean_b", F.lit(0.0))
    total = total_of_distinct("mean_a", "mean_b") if dedup else plain
    return out.withColumns(
        {"share_a": F.try_divide("mean_a", total), "share_b": F.try_divide("mean_b", total)}
    )


def check_alternating(df: DataFrame, pair: tuple[str, str], spec: PanelSpec = PANEL, measure: str | None = None):
    """Times at which both areas of the pair were observed (none in a proper panel)."""
    m = F.col(measure or spec.measures[0])
    seen = df.where(F.col(spec.area).isin(*pair) & m.isNotNull())
    return seen.groupBy(*spec.keys, spec.time).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def fill_ltmean(
    df: DataFrame,
    spec: PanelSpec = PANEL,
    *,
    pair: tuple[str, str],
    measure: str | None = None,
    mean_start: int | None = None,
    start: int | None = None,
    label: str = "ltmean",
    dedup: bool = True,
) -> DataFrame:
    """Scale the surveyed area up to the pair's total; the other area is the rest.

    Covers every time from the first to the last of the key. The result has no
    variance. A time at which both areas were observed comes out twice, once for
    each share: use :func:`check_alternating` to find such times. Several rows of one cell are
    an error.
    """
    name = measure or spec.measures[0]
    narrow = df.where(F.col(spec.area).isin(*pair)).select(*spec.cell, name)
    shares = longterm_shares(
        narrow, spec, pair=pair, measure=name, mean_start=mean_start, dedup=dedup
    ).select(*spec.keys, "share_a", "share_b")
    sides = [F.when(F.col(spec.area) == x, F.col(name)) for x in pair]
    # Stacked with the range and folded per time: the completed pair in wide form. A cell with
    # several rows would mix their values, so it is refused.
    years = narrow.unionByName(time_range(narrow, spec), allowMissingColumns=True)
    rows = [F.sum(F.when(F.col(spec.area) == x, 1)) for x in pair]
    years = years.groupBy(*spec.keys, spec.time).agg(
        *(F.max(c).alias(n) for c, n in zip(sides, ("_a", "_b"))), F.greatest(*rows).alias(COUNT)
    )
    shown = F.concat_ws(", ", *(F.col(c).cast("string") for c in (*spec.keys, spec.time)))
    repeated = F.raise_error(F.concat(F.lit("repeated cell: "), shown)).cast(df.schema[spec.time].dataType)
    years = years.withColumn(spec.time, F.when(F.col(COUNT) > 1, repeated).otherwise(F.col(spec.time))).drop(COUNT)
    years = join_on_group(years, shares, spec.keys, [spec.time])

    # Share of the area(s) surveyed at that time, at most two per row.
    observed = F.array_compact(
        F.array(
            F.when(F.col("_a").isNotNull(), F.struct(F.col("share_a").alias("share"))),
            F.when(F.col("_b").isNotNull(), F.struct(F.col("share_b").alias("share"))),
        )
    )
    years = years.withColumn("_surveyed", F.explode_outer(observed))
    total = F.try_divide(F.coalesce("_a", "_b"), F.col("_surveyed.share"))
    years = years.withColumn("_total", total)
    years = years.withColumn("_a", F.coalesce(F.col("_a"), F.col("_total") - F.col("_b")))
    # The second area reads the first one's new value.
    years = years.withColumn("_b", F.coalesce(F.col("_b"), F.col("_total") - F.col("_a")))
    halves = F.array(
        *(
            F.struct(F.lit(area).alias(spec.area), F.col(c).alias(name))
            for area, c in zip(pair, ("_a", "_b"))
        )
    )
    out = years.select(*spec.keys, spec.time, F.inline(halves))
    if start is not None:
        out = out.where(F.col(spec.time) >= start)
    return out.select(*spec.cell, name, F.lit(label).alias("method"))
