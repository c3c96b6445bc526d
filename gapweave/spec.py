"""Names and layout of a panel, and the survey schedule of its areas."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T


@dataclass(frozen=True)
class PanelSpec:
    """Column names of a panel ``(keys..., time, area, measure, measure_var, ...)``.

    ``keys + area + time`` is unique and never NULL; ``time`` is a whole number.

    ``block_span`` cuts each series into runs of that many time units. Work that
    follows the order of a series is done per ``(series, block)`` and joined up
    through one small row per block, so a single long series is spread over many
    tasks and no task or array ever holds more than ``block_span`` of its rows.

    ``buckets`` is set for a panel that is stored by series in as many buckets
    (:func:`gapweave.sources.panel_io.read_panel_table`). Its rows are then worked on where
    they are stored, and only what is added to them travels; a series lies in one bucket.
    """

    keys: tuple[str, ...] = ("species",)
    area: str = "strata"
    time: str = "year"
    measures: tuple[str, ...] = ("rpn", "rpw")
    block_span: int = 1024
    extent: tuple[int, int] | None = None
    buckets: int | None = None

    @property
    def one_block(self) -> bool:
        return self.extent is not None and self.extent[1] - self.extent[0] < self.block_span

    def measured(self, *panels: DataFrame) -> PanelSpec:
        """This layout with the extent of stored panels, from one small aggregate each."""
        ends = [p.agg(F.min(self.time), F.max(self.time)).first() for p in panels]
        known = [(lo, hi) for lo, hi in ends if lo is not None]
        if not known:
            return self
        return self.with_(extent=(min(lo for lo, _ in known), max(hi for _, hi in known)))

    def block(self) -> Column:
        """Number of the block that a row's time falls into."""
        time, span = F.col(self.time), F.lit(self.block_span)
        if self.extent is None:
            return F.floor(time / span)
        first, last = self.extent
        outside = F.raise_error(F.concat(F.lit("time outside the declared extent: "), time.cast("string")))
        number = F.floor((time - F.lit(first)) / span)
        return F.when(time.between(first, last), number).otherwise(outside.cast("bigint"))

    @property
    def series(self) -> list[str]:
        return [*self.keys, self.area]

    @property
    def cell(self) -> list[str]:
        return [*self.keys, self.area, self.time]

    @property
    def values(self) -> list[str]:
        """Measure and variance columns, in panel order."""
        return [c for m in self.measures for c in (m, self.var(m))]

    def var(self, measure: str) -> str:
        return f"{measure}_var"

    def cv(self, measure: str) -> str:
        return f"{measure}_cv"

    def with_(self, **changes) -> PanelSpec:
        return replace(self, **changes)

    def schema(self, with_area: bool = True) -> T.StructType:
        """Explicit schema of the stored panel (area panel or total index)."""
        names = [*self.keys, self.time] + ([self.area] if with_area else [])
        types = {self.time: T.IntegerType()}
        head = [T.StructField(n, types.get(n, T.StringType()), False) for n in names]
        return T.StructType(head + [T.StructField(v, T.DoubleType()) for v in self.values])


PANEL = PanelSpec()


@dataclass(frozen=True)
class Schedule:
    """Which areas are surveyed when.

    ``periodic`` maps an area to ``(period, phase)``: surveyed when
    ``time mod period = phase``. Other areas are surveyed every period if they are
    listed in ``always`` or match the pattern ``always_like``; with neither given,
    every area that is not periodic counts.
    """

    periodic: dict[str, tuple[int, int]] = field(default_factory=dict)
    always: tuple[str, ...] = ()
    always_like: str | None = None

    def surveyed(self, area: str | Column, time: str | Column) -> Column:
        area = F.col(area) if isinstance(area, str) else area
        time = F.col(time) if isinstance(time, str) else time
        rule = F.lit(False)
        for name, (period, phase) in self.periodic.items():
            rule = rule | ((area == name) & (F.pmod(time, F.lit(period)) == phase))
        if self.always:
            rule = rule | area.isin(*self.always)
        if self.always_like is not None:
            rule = rule | area.rlike(self.always_like)
        if not self.always and self.always_like is None:
            rule = rule | ~area.isin(*self.periodic)
        return rule
