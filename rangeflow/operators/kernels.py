"""Numeric workloads over an index space, as DataFrame plans."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dot, periodic_weight
from ..functions.generators import lcg_fold, lcg_next, unit
from .space import loop, loop_nd, quotient


# --- element-wise -----------------------------------------------------------


def elementwise(a: Column, b: Column, passes: int = 1000) -> Column:
    """``passes`` times sin(a) cos(b) + sqrt(a b); equal passes are one product."""
    return passes * (F.sin(a) * F.cos(b) + F.sqrt(a * b))


# --- contractions -----------------------------------------------------------


def matvec(matrix: DataFrame, x: list[float] | Column, row: str = "row") -> DataFrame:
    """``matrix`` with ``y``: each row array times a replicated vector (one array value, broadcast as a row)."""
    if isinstance(x, Column):
        return matrix.withColumn("y", dot(F.col(row), x))
    vector = matrix.sparkSession.createDataFrame([([float(v) for v in x],)], "_x array<double>")
    return matrix.crossJoin(F.broadcast(vector)).withColumn("y", dot(F.col(row), F.col("_x"))).drop("_x")


def matmul(a: DataFrame, b: DataFrame, skip_zeros: bool = False) -> DataFrame:
    """(i, j, v) from (i, k, v) and (k, j, v); with ``skip_zeros`` zeros never meet.

    A join on k and a map-side combined sum; Spark broadcasts b if it is small.
    """
    if skip_zeros:
        a, b = a.where("v <> 0"), b.where("v <> 0")
    pairs = a.select("i", "k", F.col("v").alias("va")).join(b.select("k", "j", F.col("v").alias("vb")), "k")
    return pairs.groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def spmv(matrix: DataFrame, x: DataFrame | None = None) -> DataFrame:
    """(r, y) from coordinates (r, c, v); ``x`` is (c, x), or the periodic weights."""
    if x is None:
        products = matrix.select("r", (F.col("v") * periodic_weight(F.col("c"))).alias("p"))
    else:
        products = matrix.join(x, "c").select("r", (F.col("v") * F.col("x")).alias("p"))
    return products.groupBy("r").agg(F.sum("p").alias("y"))


# --- neighbours -------------------------------------------------------------


def stencil_step(field: DataFrame, size: int, alpha: float = 0.25, block: int = 1 << 16) -> DataFrame:
    """(i, u) after one periodic step u + alpha (left - 2 u + right).

    Windows run inside blocks of indexes; only the two cells at the ends of a block come
    from its neighbours, by a join on the block (the halo).
    """
    if size < 1:
        return field.select("i", "u")
    blocks = field.select("i", "u", quotient(F.col("i"), block).alias("block"))
    last_block = (size - 1) // block
    ends = blocks.where((F.col("i") % block == 0) | (F.col("i") % block == block - 1) | (F.col("i") == size - 1))
    first, last = ends.where(F.col("i") % block == 0), ends.where((F.col("i") % block == block - 1) | (F.col("i") == size - 1))
    from_left = last.select(((F.col("block") + 1) % (last_block + 1)).alias("block"), F.col("u").alias("from_left"))
    from_right = first.select(F.pmod(F.col("block") - 1, F.lit(last_block + 1)).alias("block"), F.col("u").alias("from_right"))
    halo = from_left.join(from_right, "block")
    here = Window.partitionBy("block").orderBy("i")
    rows = blocks.withColumns({"l": F.lag("u").over(here), "r": F.lead("u").over(here)}).join(halo, "block")
    left, right = F.coalesce("l", "from_left"), F.coalesce("r", "from_right")
    return rows.select("i", (F.col("u") + alpha * (left - 2 * F.col("u") + right)).alias("u"))


def stencil_many(field: DataFrame, size: int, steps: int, cut, alpha: float = 0.25, block: int = 1 << 14, depth: int = 256) -> DataFrame:
    """(i, u) after many periodic steps: blocks with a halo of ``depth`` cells do as many steps alone.

    A round is one shuffle of the cells (and the halos, 2 depth / block more) instead of one
    a step; ``cut`` ends the lineage after it. A block is at most twice ``block`` cells in a NumPy array.
    """
    n_blocks = max(1, size // max(block, depth))
    each = size // n_blocks if n_blocks > 1 else size
    while steps > 0 and size > 0:
        k = min(depth, steps)
        field = cut(_stencil_round(field, size, each, n_blocks, k, alpha))
        steps -= k
    return field


def _stencil_round(field: DataFrame, size: int, each: int, n_blocks: int, k: int, alpha: float) -> DataFrame:
    own = F.least(quotient(F.col("i"), each), F.lit(n_blocks - 1))
    start = lambda b: b * each
    length = lambda b: F.when(b == n_blocks - 1, size - start(b)).otherwise(each)
    place = F.col("i") - start(own)
    left, right = F.pmod(own - 1, F.lit(n_blocks)), F.pmod(own + 1, F.lit(n_blocks))
    spot = lambda b, p: F.struct(b.alias("block"), p.alias("place"))
    copies = [F.array(spot(own, place))]
    if n_blocks > 1:
        none = F.array().cast("array<struct<block:bigint,place:bigint>>")
        copies.append(F.when(place < k, F.array(spot(left, length(left) + place))).otherwise(none))
        copies.append(F.when(place >= length(own) - k, F.array(spot(right, place - length(own)))).otherwise(none))

    def run(cells: pa.Table) -> pa.Table:
        order = np.argsort(cells.column("place").to_numpy())
        u, i = cells.column("u").to_numpy()[order], cells.column("i").to_numpy()[order]
        if n_blocks == 1:
            for _ in range(k):
                u = u + alpha * (np.roll(u, 1) - 2 * u + np.roll(u, -1))
        else:
            i = i[k:-k]
            for _ in range(k):
                u = u[1:-1] + alpha * (u[:-2] - 2 * u[1:-1] + u[2:])
        return pa.table({"i": pa.array(i), "u": pa.array(u)})

    dealt = field.select("i", "u", F.explode(F.concat(*copies)).alias("x")).select("i", "u", "x.block", "x.place")
    return dealt.groupBy("block").applyInArrow(run, "i long, u double")


def residual(before: DataFrame, after: DataFrame) -> DataFrame:
    """A single row: the sum of squared changes of (i, u)."""
    both = before.join(after.select("i", F.col("u").alias("un")), "i")
    return both.agg(F.sum((F.col("un") - F.col("u")) ** 2).alias("residual"))


def heat_initial(space: DataFrame, size: int) -> DataFrame:
    # 6.2831853 is the fixed value that the workload uses for two pi
    return space.select("i", (1.0 + F.sin(6.2831853 * F.col("i") / size)).alias("u"))


def life_step(cells: DataFrame, width: int, height: int) -> DataFrame:
    """(y, x, alive) after one step on a torus.

    Living cells announce themselves to their eight neighbours; one grouped sum counts
    them, so work follows the living cells.
    """
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    near = cells.where("alive = 1").select("y", "x", F.explode(around).alias("d"))
    near = near.select(F.pmod(F.col("y") + F.col("d.dy"), F.lit(height)).alias("y"), F.pmod(F.col("x") + F.col("d.dx"), F.lit(width)).alias("x"))
    both = cells.select("y", "x", "alive", F.lit(0).alias("n")).unionByName(near.select("y", "x", F.lit(0).alias("alive"), F.lit(1).alias("n")))
    sums = both.groupBy("y", "x").agg(F.max("alive").alias("alive"), F.sum("n").alias("n"))
    lives = (F.col("n") == 3) | ((F.col("alive") == 1) & (F.col("n") == 2))
    return sums.select("y", "x", lives.cast("int").alias("alive"))


# --- random points ----------------------------------------------------------


def inside_circle(seed: Column, skip: int = 2) -> Column:
    """1 if the point of two draws from the generator lies in the unit circle, else 0."""
    first = lcg_fold(seed, skip)
    x, y = unit(first), unit(lcg_next(first))
    return F.when(x * x + y * y <= 1.0, 1).otherwise(0)


def pi_estimate(points: DataFrame, hit: str = "hit") -> DataFrame:
    """A single row: hits, points and 4 hits / points."""
    return points.agg(F.sum(hit).alias("hits"), F.count(hit).alias("points"), (4.0 * F.sum(hit) / F.count(hit)).alias("pi"))


# --- synthetic loads --------------------------------------------------------


def fp_kernel(i: Column, work: Column) -> Column:
    """Sum over k < work of sin(i + k) cos(i - k) + sqrt((i + 1)(k + 1))."""
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(work.cast("long"), F.lit(1).cast("long")) - 1)
    term = lambda s, k: s + F.sin((i + k).cast("double")) * F.cos((i - k).cast("double")) + F.sqrt(((i + 1) * (k + 1)).cast("double"))
    return F.aggregate(steps, F.lit(0.0), term)


def imbalanced_work(i: Column, work: int, n: int) -> Column:
    """Work that grows with the index."""
    return F.greatest(F.lit(work // 8) + quotient(2 * work * i, max(1, n)), F.lit(1))


def mem_kernel(space: DataFrame, work: int, cells: int) -> DataFrame:
    """(i, c): sums of pseudo-random cells of a hashed buffer.

    The generator wraps at 64 bits without sign, which no column type does, so this
    runs on Arrow batches in NumPy; the buffer is a formula, never shipped.
    """
    # Fixed values of the 64-bit generator and of the hashed buffer.
    factor, offset, hashed = np.uint64(6364136223846793005), np.uint64(1442695040888963407), np.uint64(2654435761)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buffer = (np.arange(cells, dtype=np.uint64) * hashed % np.uint64(1000)).astype(np.float64) * 0.001
        for batch in batches:
            x = (batch.i.to_numpy().astype(np.uint64) + np.uint64(1)) * factor + offset
            total = np.zeros(len(x))
            for _ in range(work):
                x = x * factor + offset
                total += buffer[((x >> np.uint64(33)) % np.uint64(cells)).astype(np.int64)]
            yield pd.DataFrame({"i": batch.i, "c": total})

    return space.select("i").mapInPandas(run, "i long, c double")


# --- whole workloads --------------------------------------------------------


def vector_workload(spark, n: int = 200) -> DataFrame:
    """(i, c) with a = i + 1 and b = n - i."""
    i = F.col("i").cast("double")
    return loop(spark, n).select("i", elementwise(i + 1, F.lit(float(n)) - i).alias("c"))


def vector_nd_workload(spark, rows: int = 4, cols: int = 50) -> DataFrame:
    """(y, x, c): the same over nested loops that run as one."""
    i, n = F.col("i").cast("double"), float(rows * cols)
    return loop_nd(spark, [0, 0], [rows, cols], ["y", "x"]).select("y", "x", elementwise(i + 1, n - i).alias("c"))


def normalize_workload(spark, n: int = 4000) -> DataFrame:
    from .reduce import scaled_by_norm

    return scaled_by_norm(loop(spark, n).select("i", (1.0 + F.col("i") % 10).alias("x")), "x").select("i", "y")


def sparse_operands(spark, rows: int, inner: int, cols: int, per_row: int) -> tuple[DataFrame, DataFrame]:
    """The two patterned operands of the sparse product, later entries overwriting earlier ones."""

    def operand(n, wide, a, b, period, low, step, names):
        entries = loop(spark, n).select("i", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))).alias("k"))
        col = (a * F.col("i") + b * F.col("k")) % wide
        value = low + ((F.col("i") + F.col("k")) % period) * step
        last = entries.select("i", col.alias("c"), "k", value.alias("v")).groupBy("i", "c").agg(F.max_by("v", "k").alias("v"))
        return last.select(F.col("i").alias(names[0]), F.col("c").alias(names[1]), "v")

    return operand(rows, inner, 13, 7, 11, 0.5, 0.2, ("i", "k")), operand(inner, cols, 17, 5, 7, 0.3, 0.15, ("k", "j"))


def close(a: float, b: float, relative: float, absolute: float = 0.0) -> bool:
    """Whether a result is within the tolerance of a workload's self-check."""
    return math.isclose(a, b, rel_tol=relative, abs_tol=absolute)
