"""Ranges of indexes: slices, progress, remaining work, transfers, cache reuse.

Relations of ranges have a row for each range of a worker, ordered by ``ord``:
(rank, ord, s, e) with e exclusive. They are as many as workers times the ranges
each holds; joins between them are by overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> tuple[Column, Column]:
    return F.greatest(a_start, b_start), F.least(a_end, b_end)


def with_offsets(ranges: DataFrame) -> DataFrame:
    """Adds ``base``: how many indexes come before each range in rank and range order."""
    before = Window.partitionBy(F.lit(1)).orderBy("rank", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.col("e") - F.col("s")
    return ranges.withColumn("base", F.sum(length).over(before) - length)


def local_bases(ranges: DataFrame) -> DataFrame:
    """Adds ``base``: the place of each range in its own rank's buffer."""
    before = Window.partitionBy("rank").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.col("e") - F.col("s")
    return ranges.withColumn("base", F.sum(length).over(before) - length)


def slice_window(ranges: DataFrame, start: int, end: int) -> DataFrame:
    """(rank, ord, s, e): the real ranges behind the virtual window [start, end) of concatenated ranges."""
    rows = with_offsets(ranges)
    a, b = overlap(F.col("base"), F.col("base") + F.col("e") - F.col("s"), F.lit(start), F.lit(end))
    rows = rows.withColumns({"a": a, "b": b}).where("a < b")
    return rows.select("rank", "ord", (F.col("s") + F.col("a") - F.col("base")).alias("s"), (F.col("s") + F.col("b") - F.col("base")).alias("e"))


def _progress(ranges: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Ranges with their rank's last confirmed index (-1 before any)."""
    last = confirmed.select("rank", "confirmed")
    return ranges.join(F.broadcast(last), "rank", "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(-1).cast("long")))  # a row a worker


def remaining(ranges: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(rank, ord, s, e): what each rank has not done, from (rank, confirmed)."""
    rows = _progress(ranges, confirmed).withColumn("s", F.greatest(F.col("s"), F.col("confirmed") + 1))
    return rows.where("s < e").select("rank", "ord", "s", "e")


def done_segments(ranges: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(rank, ord, start, count): what each rank has done."""
    count = F.greatest(F.least(F.col("confirmed") + 1, F.col("e")) - F.col("s"), F.lit(0).cast("long"))
    rows = _progress(ranges, confirmed).select("rank", "ord", F.col("s").alias("start"), count.alias("count"))
    return rows.where("count > 0")


def transfer_plan(work: DataFrame, cuts: DataFrame) -> DataFrame:
    """(old_rank, new_rank, start, count): pieces of the overlap of remaining work and new cuts.

    work: (rank, remaining), cuts: (part, s, e); both in the virtual space of
    remaining indexes, a row a worker, so the range join is small.
    """
    upto = Window.partitionBy(F.lit(1)).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    old = work.select("rank", F.sum("remaining").over(upto).alias("old_e"), "remaining")
    old = old.select("rank", (F.col("old_e") - F.col("remaining")).alias("old_s"), "old_e")
    a, b = overlap(F.col("old_s"), F.col("old_e"), F.col("s"), F.col("e"))
    pieces = old.join(F.broadcast(cuts), (F.col("old_s") < F.col("e")) & (F.col("s") < F.col("old_e")))
    return pieces.select(F.col("rank").alias("old_rank"), F.col("part").alias("new_rank"), a.alias("start"), (b - a).alias("count")).where("count > 0")


def exchange(held: DataFrame, cuts: DataFrame) -> DataFrame:
    """(old_rank, new_rank, s, e, kind): which real ranges change hands, from remaining ranges and new cuts.

    held: (rank, ord, s, e), cuts: (part, s, e) in the virtual space of the held ranges, one after
    the other. A range is kept, moved, or scattered by the only rank that holds any. A few rows a worker.
    """
    rows = with_offsets(held)
    sources = held.select(F.count_distinct("rank").alias("sources"))
    target = cuts.select("part", F.col("s").alias("cs"), F.col("e").alias("ce"))
    base, n = F.col("base"), F.col("e") - F.col("s")
    a, b = overlap(base, base + n, F.col("cs"), F.col("ce"))
    met = rows.join(F.broadcast(target), (base < F.col("ce")) & (F.col("cs") < base + n)).crossJoin(F.broadcast(sources))
    kind = F.when(F.col("rank") == F.col("part"), "keep").when(F.col("sources") == 1, "scatter").otherwise("move")
    return met.select(F.col("rank").alias("old_rank"), F.col("part").alias("new_rank"), (F.col("s") + a - base).alias("s"), (F.col("s") + b - base).alias("e"), kind.alias("kind"))


def moved_rows(buffer: DataFrame, transfers: DataFrame, on: str = "i") -> DataFrame:
    """Rows of a partitioned buffer that change hands, with (old_rank, new_rank, kind); what is kept doesn't move."""
    away = transfers.where("kind <> 'keep'")
    return buffer.join(F.broadcast(away), (F.col(on) >= F.col("s")) & (F.col(on) < F.col("e"))).drop("s", "e")


def reusable(assigned: DataFrame, cached: DataFrame) -> DataFrame:
    """(rank, reuse): whether all of a rank's assigned ranges lie in its cached interval.

    assigned: (rank, s, e), cached: (rank, cs, ce). A rank without a cache cannot reuse.
    """
    inside = (F.col("s") >= F.col("cs")) & (F.col("e") <= F.col("ce"))
    return assigned.join(cached, "rank", "left").groupBy("rank").agg(F.min(F.coalesce(inside, F.lit(False))).alias("reuse"))


def missing_replicas(joiners: DataFrame, needed: DataFrame, held: DataFrame) -> DataFrame:
    """(rank, buffer) that joiners must receive: what they need and don't hold.

    Each joiner needs every buffer, so the result is as large as workers times buffers, both few.
    """
    return joiners.crossJoin(F.broadcast(needed)).select("rank", "buffer").join(held, ["rank", "buffer"], "left_anti")


def contiguous(ranges: DataFrame) -> DataFrame:
    """(rank, contiguous): ranges make one interval if their lengths add up to its width."""
    width, total = F.max("e") - F.min("s"), F.sum(F.col("e") - F.col("s"))
    return ranges.groupBy("rank").agg((width == total).alias("contiguous"))


def without_repeats(rows: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """Rows whose value differs from the one before."""
    last = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("_last", last).where(~F.col(value).eqNullSafe(F.col("_last"))).drop("_last")


def merge_results(original: DataFrame, computed: DataFrame, value: str, on: str = "i") -> DataFrame:
    """The caller's vector with what was computed put in its place; other positions keep their values."""
    new = computed.select(on, F.col(value).alias("_new"))
    return original.join(new, on, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")
