"""One query per operator, over panels derived from the order tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gapweave.functions import ci, cv, genlogit, geninvlogit, log_positive, log_sd
from gapweave.operators.ar1 import (
    ar1_filter,
    ar1_fit,
    ar1_mean,
    ar1_predict,
    ar1_series,
    fill_ar1,
    obs_pred_table,
    observation_limits,
)
from gapweave.operators.asof import join_asof
from gapweave.operators.grid import complete_grid, complete_range, pivot_area, unpivot_area
from gapweave.operators.index import reconcile, total_index
from gapweave.operators.interpolate import interpolate
from gapweave.operators.intervals import join_intervals
from gapweave.operators.linear import cv_table, fill_linear
from gapweave.operators.project import drop_like, select_like
from gapweave.operators.ratio import assign_mean_cv_variance, fill_ratio, lag_first_default
from gapweave.operators.several import fill_several
from gapweave.operators.share import fill_ltmean, longterm_shares
from gapweave.operators.stack import compare_external, score_methods, score_predictions, stack_methods
from gapweave.plans.survey_index import compare_methods, share_and_linear_index
from gapweave.sources.extract import extract_alternating, extract_total
from gapweave.sources.order_panels import (
    AREAS,
    NEIGHBOUR,
    SCHEDULE,
    START,
    TARGETS,
    daily_panel,
    raw_survey,
    segment_panel,
    supplier_day_panel,
    supplier_panel,
    supplier_total,
)
from gapweave.sources.panel_io import read_panel_csv, read_panel_table, write_panel_csv, write_panel_table
from gapweave.spec import PanelSpec, Schedule
from gapweave.storage import materialize, work_folder

METHODS = ("total_ratio", "neighbour_ratio", "linear", "ar1")
# State parameters (log_pe, logit_rho) per run of the fixed-parameter queries.
FIXED = (1.0, 3.0)
FIXED_DAILY = (0.5, 2.0)

# Decimals kept in results: enough to tell values apart, few enough to be the same
# in any engine. Values are thousands at most, variances millions.
DIGITS = {"rpn_var": 2, "rpw_var": 2}
DEFAULT_DIGITS = 6


def _rounded(df: DataFrame) -> DataFrame:
    """Round every double and order columns as they are."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, DIGITS.get(c, DEFAULT_DIGITS)) for c in doubles})


def _stored(panel: DataFrame) -> tuple[DataFrame, PanelSpec]:
    """The panel as a table, written once, and its layout with the measured extent."""
    table = materialize(panel)
    return table, PanelSpec().measured(table)


def _suppliers(spark: SparkSession, folder: str) -> tuple[DataFrame, PanelSpec]:
    return _stored(supplier_panel(spark, folder))


def _total_ratio(p: DataFrame, spec: PanelSpec) -> DataFrame:
    return fill_ratio(p, spec, targets=TARGETS, start=START, label="total_ratio")


def _neighbour_ratio(p: DataFrame, spec: PanelSpec) -> DataFrame:
    return fill_ratio(
        p, spec, targets=TARGETS, reference=NEIGHBOUR, start=START, label="neighbour_ratio"
    )


def _linear(p: DataFrame, spec: PanelSpec) -> DataFrame:
    return fill_linear(p, spec, start=START, label="linear")


def _ar1(p: DataFrame, spec: PanelSpec) -> DataFrame:
    return fill_ar1(p, spec, targets=TARGETS, params=FIXED, start=START, label="ar1")


def _several(p: DataFrame, spec: PanelSpec) -> DataFrame:
    """The first three methods from one grid."""
    references = {"total_ratio": None, "neighbour_ratio": NEIGHBOUR}
    return fill_several(p, spec, targets=TARGETS, references=references, start=START)


def _stack(p: DataFrame, spec: PanelSpec, fills) -> DataFrame:
    return stack_methods(
        [f(p, spec) for f in fills], spec, schedule=SCHEDULE, areas=AREAS, methods=METHODS
    )


# --- sources and column functions -----------------------------------------------------


def q_extract_alternating(spark, folder):
    raw = raw_survey(spark, folder)
    return _rounded(
        extract_alternating(raw, schedule=SCHEDULE, start=START, equal={"country": "BUILDING"})
    )


def q_extract_total(spark, folder):
    total = supplier_total(spark, folder)
    return _rounded(extract_total(total.toDF(*(c.upper() for c in total.columns)), start=START))


def q_select_like(spark, folder):
    p = supplier_panel(spark, folder)
    return _rounded(select_like(p, "RPN", keep=["species", "year", "strata"]))


def q_drop_like(spark, folder):
    return _rounded(drop_like(supplier_panel(spark, folder), "_VAR", "rpw"))


def q_csv_round_trip(spark, folder):
    """The panel through two CSV data sets whose columns differ in order."""
    p = materialize(supplier_panel(spark, folder))
    base = f"{work_folder(spark).rstrip('/')}/gapweave/{uuid.uuid4().hex}"
    target = F.col("strata").isin(*TARGETS)
    write_panel_csv(p.where(target), f"{base}/a")
    write_panel_csv(p.where(~target).select(*reversed(p.columns)), f"{base}/b")
    return _rounded(read_panel_csv(spark, [f"{base}/a", f"{base}/b"]))


def q_csv_inferred(spark, folder):
    """The panel read back without a schema, whole and decimal spellings mixed, with the types found."""
    p = materialize(supplier_panel(spark, folder))
    base = f"{work_folder(spark).rstrip('/')}/gapweave/{uuid.uuid4().hex}"
    target = F.col("strata").isin(*TARGETS)
    whole = F.when(F.col("rpn") == F.floor("rpn"), F.floor("rpn").cast("string")).otherwise(F.col("rpn").cast("string"))
    write_panel_csv(p.where(target).withColumn("rpn", whole), f"{base}/a")
    write_panel_csv(p.where(~target).select(*reversed(p.columns)), f"{base}/b")
    back = read_panel_csv(spark, [f"{base}/a", f"{base}/b"], infer=True)
    types = ", ".join(f"{c} {t}" for c, t in sorted(back.dtypes))
    return _rounded(back.select(*p.columns)).withColumn("types", F.lit(types))


def q_csv_inferred(spark, folder):
    """The panel read back without a schema, whole and decimal spellings mixed, with the types found."""
    p = materialize(supplier_panel(spark, folder))
    base = f"{work_folder(spark).rstrip('/')}/gapweave/{uuid.uuid4().hex}"
    target = F.col("strata").isin(*TARGETS)
    whole = F.when(F.col("rpn") == F.floor("rpn"), F.floor("rpn").cast("string")).otherwise(F.col("rpn").cast("string"))
    write_panel_csv(p.where(target).withColumn("rpn", whole), f"{base}/a")
    write_panel_csv(p.where(~target).select(*reversed(p.columns)), f"{base}/b")
    back = read_panel_csv(spark, [f"{base}/a", f"{base}/b"], infer=True)
    types = ", ".join(f"{c} {t}" for c, t in sorted(back.dtypes))
    return _rounded(back.select(*p.columns)).withColumn("types", F.lit(types))


def q_csv_inferred(spark, folder):
    """The panel read back without a schema, whole and decimal spellings mixed, with the types found."""
    p = materialize(supplier_panel(spark, folder))
    base = f"{work_folder(spark).rstrip('/')}/gapweave/{uuid.uuid4().hex}"
    target = F.col("strata").isin(*TARGETS)
    whole = F.when(F.col("rpn") == F.floor("rpn"), F.floor("rpn").cast("string")).otherwise(F.col("rpn").cast("string"))
    write_panel_csv(p.where(target).withColumn("rpn", whole), f"{base}/a")
    write_panel_csv(p.where(~target).select(*reversed(p.columns)), f"{base}/b")
    back = read_panel_csv(spark, [f"{base}/a", f"{base}/b"], infer=True)
    types = ", ".join(f"{c} {t}" for c, t in sorted(back.dtypes))
    return _rounded(back.select(*p.columns)).withColumn("types", F.lit(types))


def q_csv_inferred(spark, folder):
    """The panel read back without a schema, whole and decimal spellings mixed, with the types found."""
    p = materialize(supplier_panel(spark, folder))
    base = f"{work_folder(spark).rstrip('/')}/gapweave/{uuid.uuid4().hex}"
    target = F.col("strata").isin(*TARGETS)
    whole = F.when(F.col("rpn") == F.floor("rpn"), F.floor("rpn").cast("string")).otherwise(F.col("rpn").cast("string"))
    write_panel_csv(p.where(target).withColumn("rpn", whole), f"{base}/a")
    write_panel_csv(p.where(~target).select(*reversed(p.columns)), f"{base}/b")
    back = read_panel_csv(spark, [f"{base}/a", f"{base}/b"], infer=True)
    types = ", ".join(f"{c} {t}" for c, t in sorted(back.dtypes))
    return _rounded(back.select(*p.columns)).withColumn("types", F.lit(types))


def q_csv_inferred(spark, folder):
    """The panel read back without a schema, whole and decimal spellings mixed, with the types found."""
    p = materialize(supplier_panel(spark, folder))
    base = f"{work_folder(spark).rstrip('/')}/gapweave/{uuid.uuid4().hex}"
    target = F.col("strata").isin(*TARGETS)
    whole = F.when(F.col("rpn") == F.floor("rpn"), F.floor("rpn").cast("string")).otherwise(F.col("rpn").cast("string"))
    write_panel_csv(p.where(target).withColumn("rpn", whole), f"{base}/a")
    write_panel_csv(p.where(~target).select(*reversed(p.columns)), f"{base}/b")
    back = read_panel_csv(spark, [f"{base}/a", f"{base}/b"], infer=True)
    types = ", ".join(f"{c} {t}" for c, t in sorted(back.dtypes))
    return _rounded(back.select(*p.columns)).withColumn("types", F.lit(types))


def q_csv_inferred(spark, folder):
    """The panel read back without a schema, whole and decimal spellings mixed, with the types found."""
    p = materialize(supplier_panel(spark, folder))
    base = f"{work_folder(spark).rstrip('/')}/gapweave/{uuid.uuid4().hex}"
    target = F.col("strata").isin(*TARGETS)
    whole = F.when(F.col("rpn") == F.floor("rpn"), F.floor("rpn").cast("string")).otherwise(F.col("rpn").cast("string"))
    write_panel_csv(p.where(target).withColumn("rpn", whole), f"{base}/a")
    write_panel_csv(p.where(~target).select(*reversed(p.columns)), f"{base}/b")
    back = read_panel_csv(spark, [f"{base}/a", f"{base}/b"], infer=True)
    types = ", ".join(f"{c} {t}" for c, t in sorted(back.dtypes))
    return _rounded(back.select(*p.columns)).withColumn("types", F.lit(types))


def q_csv_inferred(spark, folder):
    """The panel read back without a schema, whole and decimal spellings mixed, with the types found."""
    p = materialize(supplier_panel(spark, folder))
    base = f"{work_folder(spark).rstrip('/')}/gapweave/{uuid.uuid4().hex}"
    target = F.col("strata").isin(*TARGETS)
    whole = F.when(F.col("rpn") == F.floor("rpn"), F.floor("rpn").cast("string")).otherwise(F.col("rpn").cast("string"))
    write_panel_csv(p.where(target).withColumn("rpn", whole), f"{base}/a")
    write_panel_csv(p.where(~target).select(*reversed(p.columns)), f"{base}/b")
    back = read_panel_csv(spark, [f"{base}/a", f"{base}/b"], infer=True)
    types = ", ".join(f"{c} {t}" for c, t in sorted(back.dtypes))
    return _rounded(back.select(*p.columns)).withColumn("types", F.lit(types))


def q_schedule_by_pattern(spark, folder):
    """Survey values where the areas surveyed always are named by a pattern."""
    schedule = Schedule(SCHEDULE.periodic, always_like="^(ASIA|EUR)")
    p = supplier_panel(spark, folder).withColumn("method", F.lit("survey"))
    out = stack_methods([p], schedule=schedule)
    return _rounded(out.select("species", "year", "strata", "obs_rpn", "obs_rpw"))


def q_cv_table(spark, folder):
    return _rounded(cv_table(supplier_panel(spark, folder)))


def q_obs_ci(spark, folder):
    out = observation_limits(supplier_panel(spark, folder), measure="rpw")
    return _rounded(out.select("species", "year", "strata", "log_rpw", "sd_log_rpw", "rpw_lci", "rpw_uci"))


def q_ci_transforms(spark, folder):
    p = supplier_panel(spark, folder)
    par, se = log_positive("rpw"), log_sd("rpw", cv("rpw", "rpw_var"))
    kinds = {
        "i": ci(par, se),
        "e": ci(par, se, type="exp"),
        "x": ci(par - 8.0, se, lo=-1, hi=1, type="expit", k=2),
        "n": ci(par, se, p=0.9),
    }
    out = p.select("species", "year", "strata", *(v.alias(k) for k, v in kinds.items()))
    parts = [F.col(k)[n].alias(f"{k}_{n}") for k in kinds for n in ("est", "se", "lci", "uci")]
    return _rounded(out.select("species", "year", "strata", *parts))


def q_logit_roundtrip(spark, folder):
    p = supplier_panel(spark, folder)
    x = F.col("rpn") / (F.col("rpn") + F.col("rpw"))
    out = p.select("species", "year", "strata", x.alias("x"))
    out = out.withColumns({"logit": genlogit("x"), "logit_wide": genlogit("x", -1, 1)})
    return _rounded(
        out.withColumns({"back": geninvlogit("logit"), "back_wide": geninvlogit("logit_wide", -1, 1)})
    )


# --- grids ----------------------------------------------------------------------------


def q_grid_complete(spark, folder):
    return _rounded(complete_grid(*_suppliers(spark, folder)))


def q_grid_complete_panel(spark, folder):
    p, spec = _suppliers(spark, folder)
    return _rounded(complete_grid(p, spec, nesting=False))


def q_grid_full_range(spark, folder):
    p, spec = _stored(daily_panel(spark, folder))
    return _rounded(complete_range(p, spec))


def q_pivot_area(spark, folder):
    return _rounded(pivot_area(supplier_panel(spark, folder), "rpn", AREAS))


def q_unpivot_area(spark, folder):
    wide = materialize(pivot_area(supplier_panel(spark, folder), "rpn", AREAS))
    return _rounded(unpivot_area(wide, "rpn", AREAS))


def q_lag_first_default(spark, folder):
    return _rounded(lag_first_default(*_suppliers(spark, folder)))


# --- fills ----------------------------------------------------------------------------


def q_mean_cv(spark, folder):
    p, spec = _suppliers(spark, folder)
    grid = complete_grid(p, spec)
    return _rounded(assign_mean_cv_variance(grid, spec, targets=TARGETS, start=START))


def q_ratio_fill_total(spark, folder):
    return _rounded(_total_ratio(*_suppliers(spark, folder)))


def q_ratio_fill_single(spark, folder):
    return _rounded(_neighbour_ratio(*_suppliers(spark, folder)))


def q_ratio_fill_daily(spark, folder):
    p, spec = _stored(daily_panel(spark, folder))
    first_day = 9200
    return _rounded(fill_ratio(p, spec, targets=TARGETS, start=first_day, label="total_ratio"))


def q_linear_interpolate(spark, folder):
    p, spec = _stored(daily_panel(spark, folder))
    grid = complete_grid(p, spec).select(*spec.cell, "rpn", "rpw")
    return _rounded(interpolate(grid, ["rpn", "rpw"], spec, maxgap=4, by="time"))


def q_linear_fill(spark, folder):
    return _rounded(_linear(*_suppliers(spark, folder)))


def q_linear_fill_stored(spark, folder):
    """On a panel stored by series: the rows are filled where they lie."""
    name = f"panel_{uuid.uuid4().hex}"
    path = f"{work_folder(spark).rstrip('/')}/gapweave/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_panel_table(supplier_panel(spark, folder), name, buckets=buckets, path=path)
    return _rounded(_linear(*read_panel_table(spark, name)))


def q_linear_fill_daily(spark, folder):
    p, spec = _stored(daily_panel(spark, folder))
    return _rounded(fill_linear(p, spec, maxgap=6, label="linear"))


def q_linear_fill_supplier_days(spark, folder):
    """Many keys, each of several blocks."""
    p, spec = _stored(supplier_day_panel(spark, folder))
    return _rounded(fill_linear(p, spec, maxgap=6, label="linear"))


def q_ltmean_share(spark, folder):
    p = supplier_panel(spark, folder)
    return _rounded(longterm_shares(p, pair=TARGETS, measure="rpw", mean_start=START))


def q_ltmean_fill(spark, folder):
    p, spec = _suppliers(spark, folder)
    return _rounded(
        fill_ltmean(p, spec, pair=TARGETS, measure="rpw", mean_start=START, start=START)
    )


# --- totals, stacks and scores --------------------------------------------------------


def q_total_index(spark, folder):
    p, spec = _suppliers(spark, folder)
    return _rounded(total_index(_total_ratio(p, spec), spec))


def q_index_fixed_cv(spark, folder):
    p, spec = _suppliers(spark, folder)
    return _rounded(
        share_and_linear_index(p, spec, pair=TARGETS, mean_start=START, start=START, scale=1000.0)
    )


def q_index_older(spark, folder):
    """Shares of two versions of the panel, the older one without its last years."""
    p, spec = _suppliers(spark, folder)
    older = p.where(F.col("year") < 1998)
    return _rounded(
        share_and_linear_index(p, spec, pair=TARGETS, mean_start=START, start=START, older=older, scale=1000.0)
    )


def q_reconcile_total(spark, folder):
    p, spec = _suppliers(spark, folder)
    total = total_index(_total_ratio(p, spec), spec, group=())
    published = extract_total(supplier_total(spark, folder), start=START)
    return _rounded(reconcile(total, published, spec))


def q_method_stack(spark, folder):
    p, spec = _suppliers(spark, folder)
    out = _stack(p, spec, (_several,))
    return _rounded(out.drop("area_order", "method_order"))


def q_ordered_methods(spark, folder):
    p, spec = _suppliers(spark, folder)
    out = _stack(p, spec, (_linear, _total_ratio))
    out = out.select("species", "strata", "area_order", "method", "method_order", "year", "rpn")
    return _rounded(out).orderBy("species", "area_order", "method_order", "year")


def q_method_score(spark, folder):
    p, spec = _suppliers(spark, folder)
    # Scores read the stack twice only where series span several blocks; stored once here.
    out = materialize(_stack(p, spec, (_several, _ar1)))
    out = score_methods(out, spec, targets=TARGETS, ranked=True)
    return _rounded(out).orderBy("species", "strata", "score_rank")


def q_compare_external(spark, folder):
    p, spec = _suppliers(spark, folder)
    grid = complete_grid(p.where(F.col("strata").isin(*TARGETS)), spec)
    external = materialize(_several(p, spec))
    withdrawn = external.where("method = 'linear'").withColumn("method", F.lit("withdrawn"))
    external = external.unionByName(withdrawn)
    return _rounded(
        compare_external(
            grid.select("species", "year", "strata", F.col("rpn").alias("obs")),
            external,
            _ar1(p, spec),
            spec,
            exclude=["withdrawn"],
            relabel=("total_ratio", "ratio", "others"),
            label="ar1",
        )
    )


def q_compare_methods(spark, folder):
    p, spec = _suppliers(spark, folder)
    out = compare_methods(
        p,
        spec,
        targets=TARGETS,
        neighbour=NEIGHBOUR,
        schedule=SCHEDULE,
        start=START,
        areas=AREAS,
        ar1_options={"params": FIXED},
    )
    return _rounded(out.totals)


def q_compare_methods_estimated(spark, folder):
    """The whole comparison with parameters that are estimated on the grid of points."""
    p, spec = _suppliers(spark, folder)
    out = compare_methods(
        p,
        spec,
        targets=TARGETS,
        neighbour=NEIGHBOUR,
        schedule=SCHEDULE,
        start=START,
        areas=AREAS,
        ar1_options={"method": "grid"},
    )
    return _rounded(out.scores)


def _asof(p: DataFrame, spec: PanelSpec, every: int, **options) -> DataFrame:
    """Target areas beside the neighbour's values, which are known at some times only."""
    observed = p.where(F.col("strata").isin(*TARGETS)).select("species", "strata", "year", "rpn")
    known = (F.col("strata") == NEIGHBOUR) & (F.col("year") % every == 0)
    external = p.where(known).select("species", "year", F.col("rpn").alias("near_rpn"), F.col("rpw").alias("near_rpw"))
    return _rounded(join_asof(observed, external, spec, on=["species"], columns=["near_rpn", "near_rpw"], **options))


def q_asof_nearest(spark, folder):
    return _asof(*_suppliers(spark, folder), 3, direction="nearest")


def q_asof_daily(spark, folder):
    """Over several blocks, and not from further away than six days."""
    return _asof(*_stored(daily_panel(spark, folder)), 10, direction="backward", tolerance=6)


def q_interval_closures(spark, folder):
    """Daily values of the target areas and the spans of days, of very unequal length, that they lie in."""
    p, spec = _stored(daily_panel(spark, folder))
    first = F.col("year").alias("start")
    last = (F.col("year") + F.pmod(F.col("year"), F.lit(70)) + F.col("rpn").cast("int")).alias("end")
    spans = p.where(F.col("year") % 25 == 0).select("species", "strata", first, last, F.col("rpw").alias("level"))
    observed = p.where(F.col("strata").isin(*TARGETS)).select("species", "strata", "year", "rpn")
    return _rounded(join_intervals(observed, spans, spec, columns=["level"]))


# --- AR(1) model ----------------------------------------------------------------------


def _series(spark, folder):
    p, spec = _suppliers(spark, folder)
    return ar1_series(p, spec, areas=TARGETS), spec


def q_ar1_filter(spark, folder):
    series, spec = _series(spark, folder)
    return _rounded(ar1_filter(series, FIXED, spec))


def q_ar1_filter_daily(spark, folder):
    p, spec = _stored(daily_panel(spark, folder))
    series = ar1_series(p, spec, areas=TARGETS)
    return _rounded(ar1_filter(series, FIXED_DAILY, spec))


def q_ar1_filter_supplier_days(spark, folder):
    p, spec = _stored(supplier_day_panel(spark, folder))
    series = ar1_series(p, spec, areas=TARGETS)
    out = ar1_filter(series, FIXED_DAILY, spec)
    return _rounded(out.select("species", "measure", "strata", "year", "m", "p", "nll"))


def q_ar1_grid_fit(spark, folder):
    series, spec = _series(spark, folder)
    return _rounded(ar1_fit(series, spec, method="grid"))


def q_ar1_predict(spark, folder):
    series, spec = _series(spark, folder)
    return _rounded(ar1_predict(series, FIXED, spec))


def q_ar1_predict_daily(spark, folder):
    p, spec = _stored(daily_panel(spark, folder))
    series = ar1_series(p, spec, areas=TARGETS)
    out = ar1_predict(series, FIXED_DAILY, spec)
    return _rounded(out.select("species", "measure", "strata", "year", "log_pred", "log_se"))


def q_ar1_fill(spark, folder):
    return _rounded(_ar1(*_suppliers(spark, folder)))


def q_ar1_fill_estimated(spark, folder):
    p, spec = _suppliers(spark, folder)
    return _rounded(fill_ar1(p, spec, targets=TARGETS, method="grid", start=START))


def _given_fit(series: DataFrame) -> DataFrame:
    """The fixed parameters with a covariance, as a fit would give them per group."""
    given = dict(zip(("log_pe", "logit_rho", "cov_pe", "cov_rho", "cov_both"), (*FIXED, 0.04, 0.25, 0.03)))
    return series.select("species", "measure").distinct().withColumns({n: F.lit(v) for n, v in given.items()})


def q_ar1_predict_total_se(spark, folder):
    series, spec = _series(spark, folder)
    return _rounded(ar1_predict(series, _given_fit(series), spec, total_se=True))


def q_prediction_score(spark, folder):
    p, spec = _suppliers(spark, folder)
    series = ar1_series(p, spec, areas=TARGETS)
    grid = complete_grid(p, spec).where(F.col("strata").isin(*TARGETS))
    table = obs_pred_table(grid, ar1_predict(series, FIXED, spec), spec, measure="rpw")
    return _rounded(score_predictions(table, spec, measure="rpw"))


def q_ar1_obs_pred(spark, folder):
    p, spec = _suppliers(spark, folder)
    series = ar1_series(p, spec, areas=TARGETS)
    grid = complete_grid(p, spec).where(F.col("strata").isin(*TARGETS))
    out = obs_pred_table(grid, ar1_predict(series, FIXED, spec), spec, measure="rpw")
    return _rounded(out.drop("rpn", "rpn_var"))


def q_ar1_mle_fit(spark, folder):
    series, spec = _series(spark, folder)
    return ar1_fit(materialize(series), spec, method="mle")


def q_ar1_estimate(spark, folder):
    """Objective at the estimate; on a ridge the parameters themselves are free."""
    series, spec = _series(spark, folder)
    out = ar1_fit(materialize(series), spec, method="mle")
    return out.select("species", "measure", F.round("nll", 3).alias("nll"), "converged")


def q_ar1_mean(spark, folder):
    """Means of the series by generalised least squares, and those that the areas share."""
    series, spec = _series(spark, folder)
    own = ar1_mean(series, FIXED, spec)
    shared = ar1_mean(series, FIXED, spec, demean=["species"]).withColumn("strata", F.lit("all"))
    return _rounded(own.unionByName(shared))


def q_ar1_filter_demeaned(spark, folder):
    series, spec = _series(spark, folder)
    return _rounded(ar1_filter(series, FIXED, spec, demean=True))


def q_ar1_predict_demeaned(spark, folder):
    series, spec = _series(spark, folder)
    return _rounded(ar1_predict(series, FIXED, spec, demean=True))


def q_ar1_predict_demeaned_daily(spark, folder):
    """Series of several blocks whose areas share a mean."""
    p, spec = _stored(daily_panel(spark, folder))
    series = ar1_series(p, spec, areas=TARGETS)
    out = ar1_predict(series, FIXED_DAILY, spec, demean=["species"])
    return _rounded(out.select("species", "measure", "strata", "year", "log_pred", "log_se"))


def q_ar1_grid_fit_demeaned(spark, folder):
    """The best starting point when each is judged at its own best means."""
    series, spec = _series(spark, folder)
    return _rounded(ar1_fit(series, spec, method="grid", demean=True))


def q_ar1_fill_demeaned(spark, folder):
    p, spec = _suppliers(spark, folder)
    out = fill_ar1(p, spec, targets=TARGETS, params=FIXED, start=START, demean=True)
    return _rounded(out)


def q_ar1_fill_mle(spark, folder):
    """The fill as it is by default: maximum likelihood, then the smoother."""
    p, spec = _suppliers(spark, folder)
    return _rounded(fill_ar1(p, spec, targets=TARGETS, start=START))


def q_compare_methods_mle(spark, folder):
    """The whole comparison with the parameters of highest likelihood."""
    p, spec = _suppliers(spark, folder)
    out = compare_methods(
        p, spec, targets=TARGETS, neighbour=NEIGHBOUR, schedule=SCHEDULE, start=START, areas=AREAS
    )
    return _rounded(out.scores)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Total index per market segment and year after filling by the ratio method."""
    p, spec = _stored(segment_panel(spark, folder))
    return _rounded(total_index(_total_ratio(p, spec), spec))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name.removeprefix("q_"): fn for name, fn in list(globals().items()) if name.startswith("q_")
}
QUERIES["segment_index"] = flagship
