"""Telemetry as a stream: epoch metrics, and policies as stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..conf import Conf
from ..operators.epoch import EpochMetrics, epoch_metrics, rate
from ..plans import policies

METRICS = "run_id long, epoch long, active_n int, remaining double, throughput double, max_rem_time double, sum_rem_time double, max_slow_streak int, epoch_elapsed double, commits int"
DECISIONS = "run_id long, epoch long, phase string, active_n int, vote string, target int, done boolean, settled boolean"


def stream_metrics(telemetry: DataFrame, watermark: str | None = None) -> DataFrame:
    """Metrics of each (run_id, epoch) as telemetry arrives.

    telemetry: run_id, epoch, rank, active, remaining, done, elapsed[, ts]. With a
    watermark on ``ts`` finished epochs leave the state.
    """
    if watermark:
        telemetry = telemetry.withWatermark("ts", watermark)
    thr = rate(F.col("done"), F.col("elapsed"))
    rates = telemetry.withColumns({"thr": thr, "epoch_thr": thr})
    rates = rates.withColumn("rem_time", F.when(F.col("thr") > 0, F.col("remaining") / F.col("thr")).otherwise(0.0))
    return epoch_metrics(rates, ("run_id", "epoch"))


def _decide(machine, universe: int, conf: Conf, state, rows: pd.DataFrame, iterative: bool = False):
    out = []
    for row in rows.sort_values("epoch").itertuples():
        m = EpochMetrics(
            active_n=int(row.active_n),
            universe=universe,
            remaining=float(row.remaining),
            throughput=float(row.throughput),
            max_rem_time=float(row.max_rem_time),
            sum_rem_time=float(row.sum_rem_time),
            max_slow_streak=int(row.max_slow_streak),
            epoch_elapsed=float(row.epoch_elapsed),
            epoch_ms=conf.epoch_ms,
            commits=int(row.commits),
            iterative=iterative,
        )
        phase = getattr(state, "phase", "")
        state, d = machine.step(state, m)
        d = policies.checked_vote(d, m)
        out.append((row.run_id, row.epoch, phase, m.active_n, d.vote, d.target, d.done, d.settled))
    return state, pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")])


def fold_policy(metrics: DataFrame, conf: Conf, universe: int, iterative: bool = False) -> DataFrame:
    """Decisions of a policy over each run's metrics, folded in order (batch)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        machine = policies.policy(conf, universe)
        return _decide(machine, universe, conf, machine.initial(), rows, iterative)[1]

    return metrics.groupBy("run_id").applyInPandas(run, DECISIONS)


def stream_policy(metrics: DataFrame, conf: Conf, universe: int) -> DataFrame:
    """The same fold over a stream; a run's state is the policy's, as JSON."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        machine = policies.policy(conf, universe)
        state = policies.restore(machine, held.get[0]) if held.exists else machine.initial()
        state, out = _decide(machine, universe, conf, state, pd.concat(list(batches)))
        held.update((policies.dump(state),))
        yield out

    return metrics.groupBy("run_id").applyInPandasWithState(run, DECISIONS, "state string", "append", GroupStateTimeout.NoTimeout)
