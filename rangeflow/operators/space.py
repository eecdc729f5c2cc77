"""Iteration spaces: one- and many-dimensional ranges, and who owns what.

A space is a DataFrame with a column of flat indexes (``i``), made by
``spark.range`` (which is already split in ranges) or any table with a dense key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONG_MAX = (1 << 63) - 1


def loop(spark: SparkSession, total: int, partitions: int | None = None) -> DataFrame:
    """``i`` from 0 to ``total`` - 1; no rows for zero or less."""
    return spark.range(0, max(0, total), 1, partitions).withColumnRenamed("id", "i")


def extents(starts: Sequence[int], limits: Sequence[int]) -> list[int]:
    """Extents of nested loops; a limit below its start counts as no iterations."""
    if len(starts) != len(limits):
        raise ValueError("as many starts as limits are needed")
    return [max(0, b - a) for a, b in zip(starts, limits, strict=True)]


def size(starts: Sequence[int], limits: Sequence[int]) -> int:
    """Number of iterations; 0 if any extent is 0, if there are none, or if it overflows a long."""
    total = 1 if starts else 0
    for e in extents(starts, limits):
        total *= e
    return total if total <= LONG_MAX else 0


def strides(ext: Sequence[int]) -> list[int]:
    """Row-major strides: the last dimension moves fastest."""
    out = [1] * len(ext)
    for d in range(len(ext) - 2, -1, -1):
        out[d] = out[d + 1] * ext[d + 1]
    return out


def decode(flat: Column, ext: Sequence[int], starts: Sequence[int] | None = None) -> list[Column]:
    """Indexes of each dimension; a negative flat index decodes to zeros (the starts)."""
    starts = starts or [0] * len(ext)
    at = F.greatest(flat, F.lit(0).cast("long"))
    return [quotient(at, s) % e + a for s, e, a in zip(strides(ext), ext, starts, strict=True)]


def quotient(a: Column, b: int) -> Column:
    """Whole quotient of longs that aren't negative; exact below 2**53 times ``b``."""
    return ((a - a % b) / b).cast("long")


def encode(indexes: Sequence[Column], ext: Sequence[int]) -> Column:
    """The flat index of an index of each dimension."""
    return sum((c * s for c, s in zip(indexes, strides(ext), strict=True)), F.lit(0).cast("long"))


def loop_nd(spark: SparkSession, starts: Sequence[int], limits: Sequence[int], names: Sequence[str]) -> DataFrame:
    """Nested loops as one space: ``i`` and a column for each dimension."""
    space = loop(spark, size(starts, limits))
    return space.select("i", *[c.alias(n) for c, n in zip(decode(F.col("i"), [max(1, e) for e in extents(starts, limits)], starts), names, strict=True)])


def owner(i: Column, total: int, parts: int) -> Column:
    """The part that owns index ``i`` of a balanced cut, in closed form.

    The first ``total % parts`` parts have one index more; inverting the start of a part
    needs no join and no shuffle.
    """
    if parts < 1:
        raise ValueError("at least one part is needed")
    base, rest = divmod(max(0, total), parts)
    big = rest * (base + 1)
    in_big = quotient(i, base + 1)
    in_small = quotient(i - big, base) + rest if base else F.lit(parts - 1)
    return F.when(i < big, in_big).otherwise(in_small).cast("int")


def bind(space: DataFrame, *aligned: DataFrame, on: str = "i") -> DataFrame:
    """Vectors attached to one space: an inner join on the index for each."""
    for vector in aligned:
        space = space.join(vector, on)
    return space
