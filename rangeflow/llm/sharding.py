"""Global shuffle into shards: a two-pass external shuffle, in DataFrame functions only.

Pass one scatters whole records over buckets small enough for memory, by a
seeded hash that is uniform whatever the ids are. Pass two shuffles each bucket in memory
(Fisher-Yates, seeded) and writes it. Buckets in order, each in its shuffled
order, are one random order of all records; dealing that order out in turns gives shards
whose numbers of rows differ by one at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut


@dataclass(frozen=True)
class ShardParams:
    shards: int = 40
    seed: int = 7
    #: What a bucket may hold in memory, on average, and how many there are at least.
    bucket_bytes: int = 32 << 20
    least_buckets: int = 16
    #: Bytes that a record takes besides its text.
    record_bytes: int = 16


def shuffled(docs: DataFrame, p: ShardParams = ShardParams()) -> DataFrame:
    """(doc_id, text, size, text_crc32, bucket, place): both passes, written to the shared folder.

    The number of buckets follows from the bytes alone, and each bucket is a partition of
    its own number, from which its shuffle is seeded: neither the session's
    partitions nor what adaptive execution merges changes the order.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    size = F.octet_length(text).cast("long") + p.record_bytes
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(-(-total // p.bucket_bytes), p.least_buckets)
    # the row's number in its file split keeps apart rows that are equal or have no id
    key = F.xxhash64(F.lit(p.seed), "doc_id", F.monotonically_increasing_id())
    rows = docs.select(key.alias("key"), "doc_id", "text", size.alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    record = F.struct(F.xxhash64("key").alias("order"), "doc_id", "text", "size", "text_crc32")
    mixed = rows.repartitionById(buckets, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(record)).alias("records"))
    mixed = mixed.select("bucket", F.posexplode(F.shuffle("records", p.seed)).alias("place", "r"))
    return cut(mixed.select("r.doc_id", "r.text", "r.size", "r.text_crc32", "bucket", F.col("place").cast("long").alias("place")), "buckets")


def shard(docs: DataFrame, p: ShardParams = ShardParams()) -> DataFrame:
    """Each record with its shard and its slot there, gapless from 0.

    docs has ``doc_id`` and ``text``; other columns are ignored. Null texts
    count as empty (their crc32 is 0), null ids and repeated rows are records
    like others, and an empty table gives no rows. ``law`` is ``rows``: the
    shards' numbers of rows are at most one apart. The order is the same for
    the same files read in the same splits, whatever the session's shuffle partitions.
    """
    rows = shuffled(docs, p)
    # a row for each bucket, so for tens of megabytes of input
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("place")
    return rows.join(cut(offsets, "offsets"), "bucket").select(
        "doc_id",
        "text",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (place % p.shards).cast("int").alias("shard"),
        ((place - place % p.shards) / p.shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, p: ShardParams = ShardParams()) -> None:
    """Write the shards as Parquet folders ``shard=<n>``, each file in slot order.

    Takes the rows that :func:`shard` takes; an empty table writes no shard.
    """
    shard(docs, p).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
