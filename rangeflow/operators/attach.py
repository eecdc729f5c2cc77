"""Binding data to an index space: vectors, matrices, CSR, ragged and replicated buffers."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import merge_results
from .space import quotient


class Access(Enum):
    PARTITIONED = "partitioned"
    SHARED_ACTIVE = "shared_active"
    SHARED_ALL = "shared_all"


#: Most bytes that a replicated buffer may have to be broadcast, by the plan's statistics; larger ones join by shuffle.
REPLICA_BYTES = 64 << 20


def attach(space: DataFrame, buffer: DataFrame, access: Access = Access.PARTITIONED, on: str = "i", result: bool = False) -> DataFrame:
    """``space`` with a buffer bound to it by a key.

    Partitioned buffers are joined by index. Replicated ones are broadcast if the
    optimizer knows them to be small (it estimates bytes from above, without running anything).
    An output (``result``) cannot be replicated on all workers, which raises.
    """
    if result and access is Access.SHARED_ALL:
        raise ValueError("an output cannot be replicated on all workers")
    if access is Access.PARTITIONED:
        return space.join(buffer, on)
    return space.join(F.broadcast(buffer) if planned_bytes(buffer) <= REPLICA_BYTES else buffer, on)


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a result's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def from_root(values: DataFrame, ranks: DataFrame, root: int = 0) -> DataFrame:
    """The root's row of ``values`` (rank and others) for every rank of ``ranks``: both have a row a worker."""
    own = values.where(F.col("rank") == root).drop("rank")
    return ranks.select("rank").crossJoin(F.broadcast(own))


def allgather(field: DataFrame, ranks: DataFrame) -> DataFrame:
    """The whole field for every rank: rows of ``field`` times the few ranks (a row a worker)."""
    return field.crossJoin(F.broadcast(ranks.select("rank")))


def ragged_resync(buffer: DataFrame, owners: DataFrame, row: str = "row") -> DataFrame:
    """(rank, i, size, base, row): a buffer of array rows dealt to new owners (rank, s, e).

    ``base`` is where a row begins in its owner's flat buffer. Owners are a few ranges a worker; rows meet
    theirs by position, and bases are summed for each owner.
    """
    held = buffer.join(F.broadcast(owners.select("rank", "s", "e")), (F.col("i") >= F.col("s")) & (F.col("i") < F.col("e")))
    size = F.coalesce(F.size(row), F.lit(0)).cast("long")
    before = Window.partitionBy("rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return held.withColumn("size", size).select("rank", "i", "size", (F.sum("size").over(before) - F.col("size")).alias("base"), row)


def output(space: DataFrame, name: str, kind: str = "double") -> DataFrame:
    """An output buffer: zeros until something is computed."""
    return space.withColumn(name, F.lit(0).cast(kind))


def gather(original: DataFrame, computed: DataFrame, value: str, on: str = "i") -> DataFrame:
    """The result as its owner sees it: computed positions replaced, others as they were."""
    return merge_results(original, computed, value, on)


def to_long(matrix: DataFrame, row: str = "row", index: str = "i") -> DataFrame:
    """(i, k, v) of a matrix with array rows."""
    return matrix.select(F.col(index).alias("i"), F.posexplode(row).alias("k", "v"))


def to_rows(cells: DataFrame) -> DataFrame:
    """(i, row) with arrays in the order of k."""
    return cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("x")).select("i", F.transform("x", lambda c: c["v"]).alias("row"))


def running_total(df: DataFrame, index: str, value: str, out: str, block: int = 1 << 16, total: str | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` before each row in the order of ``index`` (and ``total``, if named: that of all).

    Two levels: totals of index blocks (few rows) are summed in one task, rows inside
    each block in theirs. No task sorts all rows.
    """
    rows = df.withColumn("_block", quotient(F.col(index).cast("long"), block))
    totals = rows.groupBy("_block").agg(F.sum(value).alias("_n"))
    upto = Window.partitionBy(F.lit(1)).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    every = [F.sum("_n").over(Window.partitionBy(F.lit(1))).alias(total)] if total else []
    totals = totals.select("_block", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), *every)
    inside = Window.partitionBy("_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_before") + F.sum(value).over(inside) - F.col(value)
    return rows.join(totals, "_block").withColumn(out, before).drop("_block", "_before")


def csr_offsets(cells: DataFrame, rows: int) -> DataFrame:
    """(r, nnz, row_start, row_end) for every row of a coordinate matrix, empty ones too."""
    counts = cells.groupBy("r").agg(F.count("*").alias("nnz"))
    every = cells.sparkSession.range(rows).withColumnRenamed("id", "r")
    full = every.join(counts, "r", "left").select("r", F.coalesce("nnz", F.lit(0).cast("long")).alias("nnz"))
    return running_total(full, "r", "nnz", "row_start").withColumn("row_end", F.col("row_start") + F.col("nnz"))


def csr_rows(cells: DataFrame, order: str) -> DataFrame:
    """(r, cols, vals): entries of each row in input order, duplicates kept."""
    packed = cells.groupBy("r").agg(F.sort_array(F.collect_list(F.struct(order, "c", "v"))).alias("x"))
    return packed.select("r", F.transform("x", lambda e: e["c"]).alias("cols"), F.transform("x", lambda e: e["v"]).alias("vals"))


def row_stats(offsets: DataFrame) -> DataFrame:
    """A single row: most and mean entries a row."""
    return offsets.agg(F.max("nnz").alias("max_nnz"), F.avg("nnz").alias("mean_nnz"))
