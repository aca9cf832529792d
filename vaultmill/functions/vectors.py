"""Distances between array columns, computed in double precision inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _vector(v: Column | Sequence[float]) -> Column:
    return v if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v])


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def l2(a: Column, b: Column | Sequence[float]) -> Column:
    return F.sqrt(_sum(F.zip_with(a, _vector(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def cosine(a: Column, b: Column | Sequence[float]) -> Column:
    """1 - cosine similarity; null where a vector is zero."""
    b = _vector(b)
    dot = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y))
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x)))
    return F.lit(1.0) - F.try_divide(dot, norm(a) * norm(b))


METRICS = {"l2": l2, "cosine": cosine}
