"""Projection by parts of column names, whatever their case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def names_like(df: DataFrame, *parts: str) -> list[str]:
    """Columns whose name contains one of ``parts``, in the order of the table."""
    return [c for c in df.columns if any(p.lower() in c.lower() for p in parts)]


def select_like(df: DataFrame, *parts: str, keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` and those whose name contains one of ``parts``."""
    return df.select(*keep, *(c for c in names_like(df, *parts) if c not in keep))


def drop_like(df: DataFrame, *parts: str) -> DataFrame:
    """All columns but those whose name contains one of ``parts``."""
    return df.drop(*names_like(df, *parts))
