"""Gap filling, scoring and index building for panels of measured series.

Everything is a ``DataFrame -> DataFrame`` function or a ``Column`` expression,
so a call works the same on five series or on millions.
"""

from gapweave.spec import PanelSpec, Schedule

__all__ = ["PanelSpec", "Schedule"]
