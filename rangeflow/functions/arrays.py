"""Algebra of array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def periodic_weight(c: Column) -> Column:
    """The replicated vector of the sparse workloads: 1 + (c & 3) * 0.25."""
    return 1 + c.bitwiseAND(3) * 0.25


def half_away(x: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)
