"""Vector expressions over ``array<float>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Double-precision cosine; 0 for unequal lengths, empty or all-zero vectors."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    comparable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(comparable & (norms > 0), _dot(a, b) / norms).otherwise(F.lit(0.0))
