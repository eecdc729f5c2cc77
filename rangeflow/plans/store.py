"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode where the session names no folder.
LOCAL_FALLBACK = "/tmp/checkpoints/rangeflow"

_written: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; it is removed when the driver ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(found or LOCAL_FALLBACK).rstrip('/')}/run-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return f"{path}/{name}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` and read it back: lineage ends there, and lost executors take nothing with them."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            return
