"""Vector distances as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakevec.names import metric as checked_metric


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NaN for a zero vector."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(float("nan"))).otherwise(1 - dot(a, b) / lengths)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d))


def distance(metric: str, a: Column, b: Column) -> Column:
    return {"cosine": cosine_distance, "euclidean": euclidean_distance}[checked_metric(metric)](a, b)


def vector_literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))
