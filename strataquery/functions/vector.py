"""Vector math as array expressions for single comparisons; blocks of vectors go to operators.knn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, unlike lengths or a zero norm."""
    x, y = doubles(a), doubles(b)
    scale = norm(x) * norm(y)
    return F.when(F.coalesce((F.size(a) == F.size(b)) & (scale > 0), F.lit(False)), dot(x, y) / scale).otherwise(F.lit(0.0))


def literal(values) -> Column:
    """A query vector as one array literal."""
    return F.array(*(F.lit(float(v)) for v in values))
