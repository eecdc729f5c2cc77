"""Epoch telemetry: one record of metrics for each epoch, stragglers, horizons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS_THROUGHPUT = 1e-9
#: A worker whose remaining time exceeds the mean by this factor is slow.
SLOW_FACTOR = 1.5
SLOW_EPOCHS = 3


@dataclass(frozen=True)
class EpochMetrics:
    """What policies see of an epoch."""

    active_n: int = 0
    universe: int = 1
    remaining: float = 0.0
    throughput: float = 0.0
    epoch_throughput: float = 0.0
    max_throughput: float = 0.0
    min_throughput: float = 0.0
    max_rem_time: float = 0.0
    sum_rem_time: float = 0.0
    max_slow_streak: int = 0
    any_settled: bool = False
    any_loop: bool = True
    epoch_elapsed: float = 0.0
    epoch_ms: int = 1000
    commits: int = 0
    rebalance_cooldown: int = 0
    iterative: bool = False

    @property
    def imbalance(self) -> float:
        """The largest remaining time over the mean; 0 if unknown."""
        if self.active_n <= 0 or self.sum_rem_time <= EPS_THROUGHPUT:
            return 0.0
        return self.max_rem_time * self.active_n / self.sum_rem_time


def rate(done: Column, elapsed: Column) -> Column:
    return F.when((elapsed > 0) & (done > 0), done / elapsed).otherwise(0.0)


def worker_rates(telemetry: DataFrame) -> DataFrame:
    """Adds throughput, remaining time and this epoch's own throughput.

    telemetry: epoch, rank, active, remaining, done, elapsed, start (of the window in which
    ``done`` and ``elapsed`` count). An epoch's own work is the difference from the epoch
    before, or the whole window if work was dealt anew since.
    """
    before = Window.partitionBy("rank").orderBy("epoch")
    same = F.lag("start").over(before) == F.col("start")
    own_done = F.col("done") - F.when(same, F.lag("done").over(before)).otherwise(0)
    own_elapsed = F.col("elapsed") - F.when(same, F.lag("elapsed").over(before)).otherwise(0.0)
    rows = telemetry.withColumns({"thr": rate(F.col("done"), F.col("elapsed")), "epoch_thr": rate(own_done, own_elapsed)})
    return rows.withColumn("rem_time", F.when(F.col("thr") > EPS_THROUGHPUT, F.col("remaining") / F.col("thr")).otherwise(0.0))


def epoch_metrics(rates: DataFrame, by: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """One row an epoch: sums, extremes and the imbalance ratio, in one aggregate."""
    on = F.col("active")
    found = rates.groupBy(*by).agg(
        F.count_if(on).alias("active_n"),
        F.sum("remaining").alias("remaining"),
        F.sum("thr").alias("throughput"),
        F.sum("epoch_thr").alias("epoch_throughput"),
        F.max("thr").alias("max_throughput"),
        F.coalesce(F.min(F.when(on & (F.col("thr") > EPS_THROUGHPUT), F.col("thr"))), F.lit(0.0)).alias("min_throughput"),
        F.max("rem_time").alias("max_rem_time"),
        F.sum("rem_time").alias("sum_rem_time"),
        F.coalesce(F.max(F.when(on, F.col("elapsed"))), F.lit(-1.0)).alias("epoch_elapsed"),
    )
    return found.withColumn("imbalance", imbalance(F.col("max_rem_time"), F.col("sum_rem_time"), F.col("active_n")))


def imbalance(largest: Column, total: Column, active: Column) -> Column:
    return F.when((active > 0) & (total > EPS_THROUGHPUT), largest / (total / active)).otherwise(0.0)


def slow_streaks(rates: DataFrame) -> DataFrame:
    """(epoch, rank, slow, streak): for how many epochs in a row a worker has been slow.

    Islands of consecutive slow epochs; none are slow while one worker is active.
    """
    whole = Window.partitionBy("epoch")
    active = F.sum(F.col("active").cast("int")).over(whole)
    mean = F.sum("rem_time").over(whole) / active
    slow = (active > 1) & (F.sum("rem_time").over(whole) > EPS_THROUGHPUT) & (F.col("rem_time") > SLOW_FACTOR * mean)
    rows = rates.select("epoch", "rank", F.coalesce(slow, F.lit(False)).cast("int").alias("slow"))
    order = Window.partitionBy("rank").orderBy("epoch")
    rows = rows.withColumn("island", F.sum(1 - F.col("slow")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum("slow").over(Window.partitionBy("rank", "island").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("epoch", "rank", "slow", streak.cast("int").alias("streak"))


def is_done(remaining: Column, active: Column) -> Column:
    return (remaining < 1) | (active <= 0)


def short_horizon(remaining: Column, throughput: Column, active: Column, least: Column, epochs: float, epoch_s: float) -> Column:
    """Whether so little time remains that no resize pays: policies are not asked then."""
    evenly = remaining / throughput
    straggler = F.when((least > EPS_THROUGHPUT) & (active > 0), remaining / active / least).otherwise(0.0)
    return (throughput > EPS_THROUGHPUT) & (F.greatest(evenly, straggler) < epochs * epoch_s)


def horizon_is_short(m: EpochMetrics, epochs: float) -> bool:
    """:func:`short_horizon` for one record."""
    if epochs <= 0 or m.throughput <= EPS_THROUGHPUT:
        return False
    left = m.remaining / m.throughput
    if m.min_throughput > EPS_THROUGHPUT and m.active_n > 0:
        left = max(left, m.remaining / m.active_n / m.min_throughput)
    return left < epochs * m.epoch_ms / 1000


def ewma(rows: DataFrame, by: str, order: str, value: str, keep: float = 0.5, reset: str | None = None) -> DataFrame:
    """(by, ewma): keep * old + (1 - keep) * new, in order inside each group.

    As a weighted sum: a value has the weight (1 - keep) keep^age, the first one
    keep^age alone. Groups are sorted (and spill), never held in memory. Whenever the
    column ``reset`` (a size) differs from the row before, the average starts anew.
    """
    rows = rows.where(F.col(value).isNotNull())
    if reset:  # what follows the last change counts
        back = Window.partitionBy(by).orderBy(F.col(order).desc())
        changes = F.sum(F.col("_new").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, -1))
        here = ~F.lag(reset).over(Window.partitionBy(by).orderBy(order)).eqNullSafe(F.col(reset))
        rows = rows.withColumn("_new", here).withColumn("_after", F.coalesce(changes, F.lit(0))).where("_after = 0")
    newest, oldest = (Window.partitionBy(by).orderBy(c) for c in (F.col(order).desc(), F.col(order)))
    aged = rows.select(by, value, (F.row_number().over(newest) - 1).alias("age"), (F.row_number().over(oldest) == 1).alias("first"))
    weight = F.pow(F.lit(float(keep)), F.col("age")) * F.when(F.col("first"), 1.0).otherwise(1.0 - keep)
    return aged.groupBy(by).agg(F.sum(weight * F.col(value)).alias("ewma"))
