"""Synthetic sparse matrices: degrees in closed form, entries from one generator stream.

Entry number e of a matrix (in row order) takes draws 2e + 1 and 2e + 2 of the
stream, which each row works out alone, so generation needs no sequence.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import half_away
from ..functions.generators import lcg_next, with_lcg
from ..operators.attach import running_total
from ..operators.space import loop


def nearest(x: float) -> int:
    """Nearest integer, halves away from zero."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def _clamped(degree: int, n: int) -> int:
    return min(max(degree, 1), n)


def clustered_degrees(spark: SparkSession, n: int, mean: int, fraction: float = 0.25, contrast: float = 7.0) -> DataFrame:
    """(r, nnz): the first rows are ``contrast`` times as heavy as the others."""
    fraction, contrast = min(max(fraction, 0.0), 1.0), max(contrast, 1.0)
    light = mean / (fraction * contrast + 1 - fraction)
    heavy_rows = nearest(fraction * n)
    low, high = _clamped(nearest(light), n), _clamped(nearest(contrast * light), n)
    return loop(spark, n).select(F.col("i").alias("r"), F.when(F.col("i") < heavy_rows, high).otherwise(low).cast("long").alias("nnz"))


def uniform_degrees(spark: SparkSession, n: int, mean: int) -> DataFrame:
    return clustered_degrees(spark, n, mean, contrast=1.0)


def spike_degrees(spark: SparkSession, n: int, mean: int, contrast: float = 7.0, spikes: int = 4) -> DataFrame:
    """(r, nnz): evenly spaced heavy rows; the rest share what is left of n * mean."""
    spikes = max(spikes, 1)
    heavy = _clamped(nearest(mean * max(contrast, 1.0)), n)
    light = max(1, nearest((n * mean - spikes * heavy) / (n - spikes))) if n > spikes else 1
    places = sorted({min(max(int((s + 1) * n / (spikes + 1)), 0), n - 1) for s in range(spikes)})
    nnz = F.when(F.col("i").isin(places), heavy).otherwise(_clamped(light, n))
    return loop(spark, n).select(F.col("i").alias("r"), nnz.cast("long").alias("nnz"))


def powerlaw_degrees(spark: SparkSession, n: int, mean: int, s: float = 1.0) -> DataFrame:
    """(r, nnz): degrees fall with the power ``s`` of the row number."""
    weight = 1 / F.pow((F.col("i") + 1).cast("double"), F.lit(s))
    total = loop(spark, n).agg(F.sum(weight)).first()[0] or 1.0
    nnz = F.least(F.greatest(half_away(mean * n / total * weight), F.lit(1)), F.lit(n))
    return loop(spark, n).select(F.col("i").alias("r"), nnz.cast("long").alias("nnz"))


def entries(degrees: DataFrame, n: int, seed: int = 12345) -> DataFrame:
    """(r, k, c, v): the entries of each row, in order k."""
    rows = running_total(degrees, "r", "nnz", "first", block=1 << 12).where("nnz > 0")  # a task's rows become many entries
    cells = rows.select("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nnz") - 1)).alias("k"), "first")
    states = with_lcg(cells, 2 * (F.col("first") + F.col("k")) + 1, "a", seed or 1)
    b = lcg_next(F.col("a"))
    return states.select("r", "k", (F.col("a") % n).cast("int").alias("c"), (0.5 + (b % 100) * 0.01).cast("float").alias("v"))


def matrix(spark: SparkSession, pattern: str, n: int, mean: int, seed: int = 12345, contrast: float = 7.0, fraction: float = 0.25, spikes: int = 4) -> DataFrame:
    """A matrix by the name of its pattern; names that aren't known are clustered."""
    made = {
        "uniform": lambda: uniform_degrees(spark, n, mean),
        "spike": lambda: spike_degrees(spark, n, mean, contrast, spikes),
        "powerlaw": lambda: powerlaw_degrees(spark, n, mean),
    }.get(pattern, lambda: clustered_degrees(spark, n, mean, fraction, contrast))()
    return entries(made, n, seed)
