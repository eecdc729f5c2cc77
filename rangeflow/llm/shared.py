"""Shared-folder tables, so that lost executors never lose a cut of the lineage."""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode where the session names no folder (tests, a laptop).
LOCAL_FALLBACK = "/tmp/checkpoints/rangeflow"

_every: list[list[tuple[SparkSession, str]]] = []


class _Tables(threading.local):
    """The shared tables that this thread's run has written: runs in one driver don't see each other's."""

    def __init__(self) -> None:
        self.written: list[tuple[SparkSession, str]] = []
        _every.append(self.written)


_tables = _Tables()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only local mode has another if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or LOCAL_FALLBACK).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    _tables.written.append((spark, path.rsplit("/", 1)[0]))
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    Unlike a local checkpoint the files outlive any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in this run's list of shared tables, for :func:`release`."""
    return len(_tables.written)


def release(since: int, keep: int = 0) -> None:
    """Remove the shared tables that this run wrote since a mark, but for the last ``keep``.

    Called when what they led to has been written itself.
    """
    stop = len(_tables.written) - keep
    gone, _tables.written[since:stop] = _tables.written[since:stop], []
    for spark, path in gone:
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    """What is left when the driver ends (best effort: the session may have ended before)."""
    for written in _every:
        for spark, path in written:
            try:
                _remove(spark, path)
            except Exception:  # noqa: BLE001
                return


def small(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """A written table of narrow rows, to be broadcast if a count finds at most ``rows`` of them; a larger one joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextmanager
def arrow_batches(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """Jobs run inside send texts to Python in batches of at most ``most`` bytes.

    A batch is held by the JVM, in a pipe's buffers and by the worker, for each task of an executor.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def disguised(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], list]:
    """``docs`` with names of its other columns that no operator uses.

    Returns the frame (doc_id, text and the others), the names to carry, and
    columns that restore the original names and order.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {c: f"_carried_{i}" for i, c in enumerate(others)}
    back = [F.col(names.get(c, c)).alias(c) for c in docs.columns]
    return docs.select("doc_id", "text", *[docs[c].alias(n) for c, n in names.items()]), ("text", *names.values()), back


def shuffle_partitions(spark: SparkSession) -> int:
    """How many pieces the session deals a shuffle into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
