"""Arithmetic on `array<float>` embedding columns, inside the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(a: Column) -> Column:
    """Unit vector; a zero vector is returned unchanged."""
    length = norm(a)
    scale = F.when(length == 0, F.lit(1.0)).otherwise(length)
    return F.transform(a, lambda x: (x / scale).cast("float"))
