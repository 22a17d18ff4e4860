"""Angles in degrees with a period of 360."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mean_parts(angle: Column) -> tuple[Column, Column]:
    return F.avg(F.sin(F.radians(angle))), F.avg(F.cos(F.radians(angle)))


def mean(angle: Column) -> Column:
    s, c = _mean_parts(angle)
    return F.degrees(F.atan2(s, c))


def variance(angle: Column) -> Column:
    s, c = _mean_parts(angle)
    return 1 - F.sqrt(s * s + c * c)


def std(angle: Column) -> Column:
    """Circular standard deviation in degrees."""
    s, c = _mean_parts(angle)
    return F.degrees(F.sqrt(-2 * F.log(F.greatest(F.sqrt(s * s + c * c), F.lit(1e-300)))))


def cv(angle: Column) -> Column:
    return std(angle) / (F.abs(mean(angle)) + 1e-10)


def spread(angle: Column) -> Column:
    """Range; one above 180 folds to 360 less it."""
    r = F.max(angle) - F.min(angle)
    return F.when(r > 180, 360 - r).otherwise(r)


def distance(d: Column) -> Column:
    """Absolute difference on the circle."""
    return F.abs(F.pmod(d + 180, F.lit(360.0)) - 180)
