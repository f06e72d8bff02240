"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 for empty, unequal length or zero norm (F8)."""
    scale = norm(a) * norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (scale > 0)
    return F.when(usable, dot(a, b) / scale).otherwise(F.lit(0.0))
