"""Vector distances over array columns, in double precision and JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def checked(a: Column, b: Column) -> Column:
    """``a``, or an error if the dimensions differ."""
    return F.when(F.size(a) == F.size(b), a).otherwise(F.raise_error(F.lit("different vector dimensions")).cast("array<double>"))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -_sum(a, b, lambda x, y: x * y)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if a norm is 0."""
    norm = F.sqrt(_sum(a, a, lambda x, y: x * y)) * F.sqrt(_sum(b, b, lambda x, y: x * y))
    return F.when(norm == 0, F.lit(1.0)).otherwise(1 - _sum(a, b, lambda x, y: x * y) / norm)


DISTANCES = {"l2": l2_squared, "cosine": cosine_distance, "ip": negative_inner_product}
