"""Extracts of a survey table: an area panel, or a total index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gapweave.sources.panel_io import lower_names
from gapweave.spec import PANEL, PanelSpec, Schedule


def _chosen(df: DataFrame, spec: PanelSpec, equal, codes, code_column, start) -> DataFrame:
    df = lower_names(df)
    for name, value in (equal or {}).items():
        df = df.where(F.col(name) == value)
    if codes is not None:
        df = df.where(F.col(code_column).isin(*codes))
    return df.where(F.col(spec.time) >= start)


def extract_alternating(
    df: DataFrame,
    spec: PanelSpec = PANEL,
    *,
    schedule: Schedule,
    start: int,
    equal: dict[str, str] | None = None,
    codes: Sequence[str] | None = None,
    code_column: str = "species_code",
    area_column: str = "council_management_area",
) -> DataFrame:
    """Area panel of the rows in schedule from ``start``, sorted by key, area, time.

    ``equal`` holds equality conditions and ``codes`` the wanted key codes. Areas
    outside the schedule are left out if the schedule lists the others.
    """
    rows = _chosen(df, spec, equal, codes, code_column, start)
    rows = rows.where(schedule.surveyed(area_column, spec.time))
    return rows.select(
        *spec.keys, spec.time, F.col(area_column).alias(spec.area), *spec.values
    ).orderBy(*spec.cell)


def extract_total(
    df: DataFrame,
    spec: PanelSpec = PANEL,
    *,
    start: int,
    equal: dict[str, str] | None = None,
    codes: Sequence[str] | None = None,
    code_column: str = "species_code",
) -> DataFrame:
    """Total index from ``start``, sorted by time."""
    rows = _chosen(df, spec, equal, codes, code_column, start)
    return rows.select(*spec.keys, spec.time, *spec.values).orderBy(spec.time, *spec.keys)
