from rangeflow.conf import Conf
from rangeflow.streaming.telemetry import fold_policy, stream_metrics, stream_policy

METRICS = "run_id long, epoch long, active_n int, remaining double, throughput double, max_rem_time double, sum_rem_time double, max_slow_streak int, epoch_elapsed double, commits int"


def metrics(epochs):
    sizes = [8, 1, 1, 1, 8, 4, 6, 7]
    return [(run, e, sizes[e % 8], 1e6, 100.0 * sizes[e % 8] / (1 + 0.1 * sizes[e % 8]), 1.0, 4.0, 0, 1.0, 0) for run in (1, 2) for e in epochs]


def test_stream_and_batch_decide_alike(spark, tmp_path):
    conf = Conf(elastic=True, policy="auto")
    for k in range(4):
        spark.createDataFrame(metrics(range(2 * k, 2 * k + 2)), METRICS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(METRICS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = stream_policy(source, conf, 8).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    batch = fold_policy(spark.createDataFrame(metrics(range(8)), METRICS), conf, 8)
    key = lambda rows: sorted(map(tuple, rows))
    got = key(spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == key(batch.collect()) and len(got) == 16 and any(r[4] == "RESIZE" for r in got)


def test_metrics_of_a_stream(spark, tmp_path):
    schema = "run_id long, epoch long, rank int, active boolean, remaining double, done double, elapsed double, ts timestamp"
    rows = spark.sql("SELECT 1L run_id, id div 4 epoch, cast(id % 4 as int) rank, true active, 10.0D remaining, 5.0D done, 2.0D elapsed, timestamp'2024-01-01' ts FROM range(12)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = stream_metrics(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), watermark="1 minute")
    run = stream.writeStream.format("memory").queryName("metrics").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.table("metrics").orderBy("epoch").collect()
    assert [(r.epoch, r.active_n, r.remaining, r.throughput, r.imbalance) for r in got] == [(e, 4, 40.0, 10.0, 1.0) for e in range(3)]
