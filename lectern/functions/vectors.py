"""Vector columns: normalisation and dot products, native and in blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles; NaN counts as 0 and infinities as +-1."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.isnan(total), 0.0).when(total == float("inf"), 1.0).when(total == float("-inf"), -1.0).otherwise(total)


def clean(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Unit length; NaN and infinities count as 0; a zero vector stays zero."""
    x = clean(v)
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    return F.when(length == 0, x).otherwise(F.transform(x, lambda y: y / length))
