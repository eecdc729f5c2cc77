"""Typed associative reductions with identities.

An empty input, or one of nulls alone, gives the identity of the operation
and type instead of null. Integer sums and extremes stay in longs; products
are doubles (integer products overflow at once).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lowest and highest finite value of each type.
LIMITS = {
    "int": (-(1 << 31), (1 << 31) - 1),
    "long": (-(1 << 63), (1 << 63) - 1),
    "longlong": (-(1 << 63), (1 << 63) - 1),
    "uint": (0, (1 << 32) - 1),
    "ulong": (0, (1 << 64) - 1),
    "float": (-3.4028234663852886e38, 3.4028234663852886e38),
    "double": (-1.7976931348623157e308, 1.7976931348623157e308),
}

SPARK_TYPES = {"int": "int", "long": "bigint", "longlong": "bigint", "uint": "bigint", "ulong": "decimal(20,0)", "float": "float", "double": "double"}

OPS = ("sum", "prod", "max", "min")


def identity(op: str, dtype: str):
    """The value that changes nothing; unknown operations and types raise."""
    if dtype not in LIMITS:
        raise ValueError(f"unknown type {dtype!r}; one of {sorted(LIMITS)}")
    if op not in OPS:
        raise ValueError(f"unknown operation {op!r}; one of {OPS}")
    whole = dtype not in ("float", "double")
    neutral = {"sum": 0, "prod": 1}.get(op)
    if neutral is not None:
        return neutral if whole else float(neutral)
    return LIMITS[dtype][op == "min"]


def literal(op: str, dtype: str) -> Column:
    value = identity(op, dtype)
    if dtype == "ulong":
        return F.lit(str(value)).cast(SPARK_TYPES[dtype])
    return F.lit(value).cast(SPARK_TYPES[dtype])


def reduced(value: Column, op: str, dtype: str) -> Column:
    """The reduction of a column as an aggregate expression (nulls are skipped)."""
    neutral, kind = literal(op, dtype), SPARK_TYPES[dtype]
    found = {"sum": F.sum, "prod": F.product, "max": F.max, "min": F.min}[op](value.cast(kind))
    if op == "prod":
        return F.coalesce(found, F.lit(1.0))
    if op == "sum" and dtype == "uint":
        found = found.bitwiseAND((1 << 32) - 1)  # unsigned sums wrap around
        return F.coalesce(found, neutral)
    wide = "bigint" if op == "sum" and dtype == "int" else "double" if op == "sum" and dtype == "float" else kind
    return F.coalesce(found.cast(wide), neutral.cast(wide))


@dataclass(frozen=True)
class Accumulator:
    """One reduction to run with others in a single aggregate."""

    name: str
    column: str
    op: str = "sum"
    dtype: str = "long"


def reduce(df: DataFrame, accumulators: Iterable[Accumulator], by: Iterable[str] = ()) -> DataFrame:
    """All accumulators in one pass (one shuffle of partial aggregates), over all rows or by group."""
    found = [reduced(F.col(a.column), a.op, a.dtype).alias(a.name) for a in accumulators]
    by = list(by)
    return df.groupBy(*by).agg(*found) if by else df.agg(*found)


def combine(partials: DataFrame, accumulators: Iterable[Accumulator], by: Iterable[str] = ()) -> DataFrame:
    """Partial results (columns named like the accumulators) folded with the same operations."""
    again = [Accumulator(a.name, a.name, a.op, "long" if a.op == "sum" and a.dtype == "int" else "double" if a.op == "prod" or a.op == "sum" and a.dtype == "float" else a.dtype) for a in accumulators]
    return reduce(partials, again, by)


@dataclass(frozen=True)
class UserAggregate:
    """A reduction of the user's own: a state of numbers, what a batch of values adds to it, and how two states merge."""

    zero: tuple[float, ...]
    add: Callable[[tuple[float, ...], np.ndarray], tuple[float, ...]]
    merge: Callable[[tuple[float, ...], tuple[float, ...]], tuple[float, ...]]


def reduce_user(df: DataFrame, column: str, how: UserAggregate) -> DataFrame:
    """A single row with the final ``state``: each partition folds its batches, and the partial states are merged.

    Nulls are skipped; an empty input gives ``zero``. What meets in one task is a state a partition.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = how.zero
        for batch in batches:
            state = how.add(state, batch.column(0).drop_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([list(map(float, state))], pa.list_(pa.float64()))], names=["state"])

    def final(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"state": [list(functools.reduce(how.merge, map(tuple, rows.state), how.zero))]})

    states = df.select(F.col(column).cast("double")).mapInArrow(partial, "state array<double>")
    zero = df.sparkSession.createDataFrame([([float(x) for x in how.zero],)], "state array<double>")
    return states.union(zero).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(final, "state array<double>")


def array_reduce(df: DataFrame, column: str, op: str = "sum", dtype: str = "double") -> DataFrame:
    """(pos, value): the reduction of each element of an array column over all rows."""
    return df.select(F.posexplode(column).alias("pos", "v")).groupBy("pos").agg(reduced(F.col("v"), op, dtype).alias("value"))


def norm(df: DataFrame, column: str) -> DataFrame:
    """A single row with the Euclidean norm of a column."""
    return df.agg(F.sqrt(F.coalesce(F.sum(F.col(column) * F.col(column)), F.lit(0.0))).alias("norm"))


def scaled_by_norm(df: DataFrame, column: str, out: str = "y") -> DataFrame:
    """Each value over the norm of all; zeros where the norm is zero."""
    y = F.when(F.col("norm") > 0, F.col(column) / F.col("norm")).otherwise(0.0)
    return df.crossJoin(F.broadcast(norm(df, column))).withColumn(out, y).drop("norm")  # a single row
