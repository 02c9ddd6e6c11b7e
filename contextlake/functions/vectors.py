"""Column functions over vectors, computed in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_vector(values: Sequence[float]) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance; null for vectors of unequal length."""
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of the angle; 0 where a vector is null, empty, all zero or of another length than the other."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), _dot(a, b) / norms), F.lit(0.0))
