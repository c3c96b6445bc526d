"""Numbers with their first and second derivatives in two parameters, many at a time.

A number is carried as six values: itself, its two slopes and its three curvatures. Sums,
products, inverses and logarithms follow the rules of the calculus, so what is computed
from such numbers has exact derivatives without differences of nearby values. Values are
arrays; the plain number 0.0 stands for an array of zeros and costs nothing.
"""

from __future__ import annotations

import numpy as np

Value = np.ndarray | float
PARTS = ("", "_x", "_y", "_xx", "_xy", "_yy")


def _zero(v: Value) -> bool:
    return isinstance(v, float) and v == 0.0


def _mul(a: Value, b: Value) -> Value:
    return 0.0 if _zero(a) or _zero(b) else a * b


def _add(*terms: Value) -> Value:
    out: Value = 0.0
    for t in terms:
        out = t if _zero(out) else out if _zero(t) else out + t
    return out


class Dual:
    """Numbers with their derivatives."""

    __slots__ = ("v", "x", "y", "xx", "xy", "yy")

    def __init__(self, v: Value, x: Value = 0.0, y: Value = 0.0, xx: Value = 0.0, xy: Value = 0.0, yy: Value = 0.0):
        self.v, self.x, self.y, self.xx, self.xy, self.yy = v, x, y, xx, xy, yy

    @property
    def parts(self) -> tuple[Value, ...]:
        return self.v, self.x, self.y, self.xx, self.xy, self.yy

    def __add__(self, other: Dual | Value) -> Dual:
        if not isinstance(other, Dual):
            return Dual(self.v + other, *self.parts[1:])
        return Dual(*map(_add, self.parts, other.parts))

    def __sub__(self, other: Dual) -> Dual:
        return self + other * -1.0

    def __mul__(self, other: Dual | Value) -> Dual:
        if not isinstance(other, Dual):
            return Dual(*(_mul(p, other) for p in self.parts))
        a, b = self, other
        return Dual(
            _mul(a.v, b.v),
            _add(_mul(a.x, b.v), _mul(a.v, b.x)),
            _add(_mul(a.y, b.v), _mul(a.v, b.y)),
            _add(_mul(a.xx, b.v), _mul(2.0, _mul(a.x, b.x)), _mul(a.v, b.xx)),
            _add(_mul(a.xy, b.v), _mul(a.x, b.y), _mul(a.y, b.x), _mul(a.v, b.xy)),
            _add(_mul(a.yy, b.v), _mul(2.0, _mul(a.y, b.y)), _mul(a.v, b.yy)),
        )

    def _through(self, value: Value, slope: Value, bend: Value) -> Dual:
        """A function of this number with the given value, slope and curvature there."""
        x, y = self.x, self.y
        return Dual(
            value,
            _mul(slope, x),
            _mul(slope, y),
            _add(_mul(slope, self.xx), _mul(bend, _mul(x, x))),
            _add(_mul(slope, self.xy), _mul(bend, _mul(x, y))),
            _add(_mul(slope, self.yy), _mul(bend, _mul(y, y))),
        )

    def inverse(self) -> Dual:
        i = 1.0 / self.v
        return self._through(i, -i * i, 2.0 * i * i * i)

    def log(self) -> Dual:
        i = 1.0 / self.v
        return self._through(np.log(self.v), i, -i * i)

    def where(self, seen: np.ndarray, other: Dual) -> Dual:
        """These numbers where ``seen``, elsewhere the others."""
        pairs = zip(self.parts, other.parts)
        return Dual(*(0.0 if _zero(a) and _zero(b) else np.where(seen, a, b) for a, b in pairs))
