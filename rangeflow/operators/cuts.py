"""Cuts: how an index range is divided among workers.

Cuts are ascending starts, one for each part, and the total at the end. Inputs
here are as many as there are workers (never as many as there are data), except where a
function takes a DataFrame of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import half_away
from .attach import running_total

EPS_WEIGHT = 1e-12


def balanced(total: int, parts: int) -> list[int]:
    """Parts of equal size; the first ones take what is left over."""
    base, rest = divmod(max(0, total), parts)
    return [r * base + min(r, rest) for r in range(parts + 1)]


def weighted(total: int, weights: Sequence[float] | None, parts: int, balancing: bool = True) -> list[int]:
    """Parts in proportion to weights, by largest remainders.

    Equal remainders go to lower parts first. While there are indexes enough, an
    empty part takes one from the largest. Without balancing, weights or a
    positive sum the cut is :func:`balanced`.
    """
    own = [max(0.0, w) for w in (weights or [])[:parts]]
    if not balancing or len(own) < parts or sum(own) <= 0:
        return balanced(total, parts)
    shares = [total * w / sum(own) for w in own]
    sizes = [int(s) for s in shares]
    by_rest = sorted(range(parts), key=lambda r: (sizes[r] - shares[r], r))
    for r in by_rest[: total - sum(sizes)]:
        sizes[r] += 1
    if total >= parts:
        while 0 in sizes:
            sizes[sizes.index(max(sizes))] -= 1
            sizes[sizes.index(0)] += 1
    return [sum(sizes[:r]) for r in range(parts + 1)]


def updated_weights(throughputs: Sequence[float], old_size: int, target: int) -> list[float]:
    """Weights after a resize: uniform when growing, else shares of measured throughput."""
    total = sum(throughputs[:target])
    if target > old_size or total <= EPS_WEIGHT:
        return [1 / max(1, target) if k < target else 0.0 for k in range(len(throughputs))]
    return [x / total if k < target else 0.0 for k, x in enumerate(throughputs)]


def weighted_cuts(weights: DataFrame, total: int, balancing: bool = True) -> DataFrame:
    """(rank, start, size) from (rank, weight): :func:`weighted` of the table's rows, in the order of ranks.

    The table has one row a worker, so one task holds it.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        found = weighted(total, rows.weight.tolist(), len(rows), balancing)
        return pd.DataFrame({"rank": rows["rank"], "start": found[:-1], "size": [b - a for a, b in zip(found, found[1:], strict=False)]})

    kind = weights.schema["rank"].dataType.simpleString()
    return weights.select("rank", F.col("weight").cast("double").alias("weight"), F.lit(0).alias("all")).groupBy("all").applyInPandas(run, f"rank {kind}, start long, size long")


def cost_cuts(telemetry: DataFrame, target: int) -> DataFrame:
    """(part, cut) where cumulative cost crosses equal shares.

    telemetry: (rank, remaining, done, elapsed), one row a worker. A rank's cost density is
    elapsed / done (that of all ranks, or 1, where it has not done anything). Cuts are
    rounded half away from zero, ascend, and end at the total.
    """
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.partitionBy(F.lit(1)).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_done, all_elapsed = F.sum("done").over(every), F.sum("elapsed").over(every)
    usual = F.when((all_done > EPS_WEIGHT) & (all_elapsed > 0), all_elapsed / all_done).otherwise(1.0)
    own = F.when((F.col("done") > EPS_WEIGHT) & (F.col("elapsed") > 0), F.col("elapsed") / F.col("done")).otherwise(usual)
    rows = telemetry.select("rank", "remaining", own.alias("density"))
    rows = rows.withColumn("cost", F.col("remaining") * F.col("density"))
    rows = rows.select(
        "rank",
        "remaining",
        "density",
        "cost",
        F.sum("cost").over(upto).alias("cost_to"),
        F.sum("remaining").over(upto).alias("rows_to"),
        F.sum("cost").over(every).alias("all_cost"),
        F.sum("remaining").over(every).alias("all_rows"),
        F.max("rank").over(every).alias("last"),
    )
    spark = telemetry.sparkSession
    parts = spark.range(1, target).select(F.col("id").cast("int").alias("part"))
    wanted = F.col("part") * F.col("all_cost") / target
    # the first rank whose cumulative cost reaches the share; both tables have a row a worker
    reach = parts.join(F.broadcast(rows), (F.col("cost_to") >= wanted) | (F.col("rank") == F.col("last")))
    first = reach.groupBy("part").agg(F.min(F.struct("rank", "remaining", "density", "cost", "cost_to", "rows_to", "all_cost", "all_rows")).alias("x")).select("part", "x.*")
    base_rows, base_cost = F.col("rows_to") - F.col("remaining"), F.col("cost_to") - F.col("cost")
    at = F.when(F.col("density") > 0, base_rows + half_away((wanted - base_cost) / F.col("density"))).otherwise(base_rows)
    cuts = first.select("part", F.least(at, F.col("all_rows")).cast("long").alias("cut"))
    ends = rows.agg(F.max("all_rows").cast("long").alias("all_rows")).select(F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("cut")), F.struct(F.lit(target).alias("part"), F.coalesce("all_rows", F.lit(0).cast("long")).alias("cut")))).alias("x")).select("x.*")
    rising = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cuts.unionByName(ends).select("part", F.max("cut").over(rising).alias("cut"))


def cost_cuts_of(remaining: Sequence[int], done: Sequence[float], elapsed: Sequence[float], target: int) -> list[int]:
    """:func:`cost_cuts` of plain lists (for the controller, which has a row a worker)."""
    total = sum(remaining)
    usual = sum(elapsed) / sum(done) if sum(done) > EPS_WEIGHT and sum(elapsed) > 0 else 1.0
    density = [e / d if d > EPS_WEIGHT and e > 0 else usual for d, e in zip(done, elapsed, strict=True)]
    costs = [n * d for n, d in zip(remaining, density, strict=True)]
    if total <= 0 or sum(costs) <= 0:
        return balanced(total, target)
    out = [0]
    for part in range(1, target):
        wanted, cost, rows, k = part * sum(costs) / target, 0.0, 0, 0
        while k < len(costs) - 1 and cost + costs[k] < wanted:
            cost, rows, k = cost + costs[k], rows + remaining[k], k + 1
        at = rows + int((wanted - cost) / density[k] + 0.5) if density[k] > 0 else rows
        out.append(min(max(at, out[-1]), total))
    return [*out, total]


def row_cuts(degrees: DataFrame, parts: int, row: str = "r", size: str = "nnz") -> DataFrame:
    """(part, cut) for parts 1 to ``parts`` - 1: the first row whose cumulative size reaches each share.

    degrees has a row a matrix row. Sums run block by block, and each row finds the
    shares that it is the first to reach: no task sees all rows.
    """
    rows = running_total(degrees.select(F.col(row).alias("r"), F.col(size).cast("long").alias("n")), "r", "n", "before", total="total").where("total > 0")
    reached = lambda c: (c * parts - c * parts % F.col("total")) / F.col("total")  # noqa: E731  shares up to a cumulative size
    hit = rows.withColumns({"low": reached(F.col("before")).cast("int"), "high": reached(F.col("before") + F.col("n")).cast("int")})
    shares = F.explode(F.sequence(F.col("low") + 1, "high")).alias("part")
    return hit.where("high > low").select(shares, F.col("r").alias("cut")).where(F.col("part") < parts)
