"""Trace and bench rows, and their CSV form with a leading tag."""

from __future__ import annotations

import logging

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conf import Conf
from .operators.epoch import EPS_THROUGHPUT
from .plans.controller import Wave, task_metrics

log = logging.getLogger("rangeflow")

# Tags and fields that readers of these records expect.
TRACE = "tag string, rank int, t double, epoch long, key string, old int, new int, value double, thr1 double, speedup double, eff double"
BENCH = "tag string, example string, variant string, mode string, np int, np_active int, work_items long, seconds double, errors long"
THREAD = "tag string, stage int, rank int, run_ms double, cpu_ms double, gc_ms double, peak_bytes long, rows_in long, rows_out long, shuffle_read long, shuffle_written long, spilled long"


class OneWorker(logging.Filter):
    """Lets records of the driver and of the first partition pass, or of all of them."""

    def __init__(self, all_workers: bool = False):
        super().__init__()
        self.all_workers = all_workers

    def filter(self, record: logging.LogRecord) -> bool:
        task = TaskContext.get()
        rank = getattr(record, "rank", task.partitionId() if task else 0)
        return self.all_workers or rank == 0


def set_level(conf: Conf) -> None:
    """The library's log level (unknown names are INFO), and which workers log."""
    log.setLevel(getattr(logging, conf.log_level.upper(), logging.INFO))
    for old in [f for f in log.filters if isinstance(f, OneWorker)]:
        log.removeFilter(old)
    log.addFilter(OneWorker(conf.log_all_workers))


def trace_rows(spark: SparkSession, waves: list[Wave], probes: bool = True) -> DataFrame:
    """START and END of each worker in each wave, RESIZE rows, probes, and the result.

    The driver sends a row a wave; executors make the rows of its workers.
    """
    rows, t = [], 0.0
    for w in waves:
        end = t + max(w.seconds, default=0.0)
        rows.append((w.epoch, w.size, t, end, w.outcome.target if w.outcome.resize else None, w.metrics.throughput, w.single))
        t = end
    table = spark.createDataFrame(rows, "epoch long, size int, t double, end double, target int, thr double, single double")
    none = lambda kind: F.lit(None).cast(kind)

    def row(tag, rank, at, epoch="epoch", key=None, old=None, new=None, value=None, thr1=None, speedup=None, eff=None):
        given = zip(TRACE.split(", "), (F.lit(tag), rank, at, epoch, key, old, new, value, thr1, speedup, eff), strict=True)
        return [(none(f.split()[1]) if c is None else F.col(c) if isinstance(c, str) else c).cast(f.split()[1]).alias(f.split()[0]) for f, c in given]

    each = table.withColumn("rank", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    out = each.select(row("START", "rank", "t")).union(each.select(row("END", "rank", "end")))
    if probes:
        known = F.when(F.col("single") > EPS_THROUGHPUT, F.col("single"))
        speedup = F.col("thr") / known
        out = out.union(table.select(row("PROBE", F.lit(0), "t", key=F.lit("throughput"), old="size", value="thr", thr1=known, speedup=speedup, eff=speedup / F.col("size"))))
    out = out.union(table.where("target is not null").select(row("RESIZE", F.lit(0), "end", old="size", new="target")))
    out = out.union(table.agg(F.count("*").alias("n"), F.max("end").alias("end")).select(row("META", F.lit(0), "end", epoch=None, key=F.lit("waves"), value="n")))
    return out.union(table.agg(F.count("target").alias("n"), F.max("end").alias("end")).select(row("RESULT", F.lit(0), "end", epoch=None, key=F.lit("resizes"), value="n")))


def timing_rows(spark: SparkSession, timers: dict[str, float]) -> DataFrame:
    """One row a named timer, such as those of :attr:`rangeflow.plans.controller.Run.timers`."""
    rows = [("TIMING", 0, None, None, k, None, None, float(v), None, None, None) for k, v in timers.items()]
    return spark.createDataFrame(rows, TRACE)


def thread_rows(spark: SparkSession, stage: int) -> DataFrame:
    """One row a task of a stage, with what Spark measures of it (bounded by the stage's partitions)."""
    found = task_metrics(spark.sparkContext, stage)
    rows = [("TM", t["stage"], t["rank"], float(t["run_ms"]), float(t["cpu_ms"]), float(t["gc_ms"]), *[int(t[k]) for k in ("peak_bytes", "rows_in", "rows_out", "shuffle_read", "shuffle_written", "spilled")]) for t in found]
    return spark.createDataFrame(rows, THREAD)


def bench_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(example, variant, mode, np, np_active, work_items, seconds, errors) with their tag."""
    return spark.createDataFrame([("CSV", *r) for r in rows], BENCH)


def as_csv(rows: DataFrame) -> DataFrame:
    """One text column: the tag and the fields of its kind, comma-separated, absent ones left out."""
    return rows.select(F.concat_ws(",", *rows.columns).alias("value"))
