"""Column functions on coordinates. They stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
XY = ("x", "y")

#: Builds a distance column from the column-name prefixes of two points and their dimensions.
Metric = Callable[[Sequence[Column], Sequence[Column]], Column]


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Sum of squared differences, written as products so that every engine rounds alike."""
    terms = [(p - q) * (p - q) for p, q in zip(a, b, strict=True)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def euclidean(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(squared_distance(a, b))


def cell(value: Column, size: float) -> Column:
    """Index of the half-open grid cell of width ``size`` that holds the value."""
    return F.floor(value / F.lit(float(size))).cast("long")


def equal_points(a: Sequence[Column], b: Sequence[Column], tolerance: float = 1e-6) -> Column:
    """All coordinates closer than the tolerance."""
    out = F.lit(True)
    for p, q in zip(a, b, strict=True):
        out = out & (F.abs(p - q) < F.lit(tolerance))
    return out


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = a[0] * b[0]
    for p, q in zip(a[1:], b[1:], strict=True):
        out = out + p * q
    return out


def transformed(matrix: Sequence[Sequence[float]], point: Sequence[Column]) -> list[Column]:
    """Coordinates of a point under a 4x4 rigid transform (last row ignored)."""
    return [F.lit(float(r[0])) * point[0] + F.lit(float(r[1])) * point[1] + F.lit(float(r[2])) * point[2] + F.lit(float(r[3])) for r in matrix[:3]]


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))
