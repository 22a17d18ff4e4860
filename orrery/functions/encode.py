"""Encodings of classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Secondary-structure classes in the order of their codes.
FULL = ("H", "B", "E", "G", "I", "T", "S", "C", "NA")
SIMPLE = ("H", "E", "C", "NA")


def integer(value: Column, classes: Sequence[str]) -> Column:
    """Place of a class; 0 for unknown ones."""
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), value)
    return F.coalesce(F.when(at > 0, at - 1), F.lit(0)).cast("int")


def onehot(value: Column, classes: Sequence[str]) -> Column:
    return F.array(*[F.coalesce((value == c).cast("double"), F.lit(0.0)) for c in classes])


def from_onehot(values: Column, width: int) -> Column:
    """Place of the largest entry in each group of ``width``."""
    n = (F.size(values) / width).cast("int")
    group = lambda k: F.slice(values, k * width + 1, F.lit(width))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: (F.array_position(group(k), F.array_max(group(k))) - 1).cast("int"))


def is_onehot(values: Column, width: int) -> Column:
    n = (F.size(values) / width).cast("int")
    one = lambda k: F.abs(F.aggregate(F.slice(values, k * width + 1, F.lit(width)), F.lit(0.0), lambda x, y: x + y) - 1) < 1e-6
    return (F.size(values) % width == 0) & (n > 0) & F.forall(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one)


def simplified(value: Column) -> Column:
    return F.when(value.isin("H", "G", "I"), "H").when(value.isin("E", "B"), "E").when(value.isNull() | (value == "NA"), "NA").otherwise("C")
