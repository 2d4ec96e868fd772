"""Scalar column functions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(x: Column) -> Column:
    return F.transform(x, lambda v: v / F.greatest(F.sqrt(dot(x, x)), F.lit(1e-12)))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct<centre, half> of the Wilson interval; null where n is 0."""
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.struct(centre.alias("centre"), half.alias("half")))
