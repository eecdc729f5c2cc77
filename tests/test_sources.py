import numpy as np
import pytest

from rangeflow import conf, trace
from rangeflow.functions.generators import jump
from rangeflow.operators import attach, kernels, ranges, reduce, space
from rangeflow.plans.controller import Controller, run_steps
from rangeflow.sources import mtx, synthetic

GOOD = "%%MatrixMarket matrix coordinate real general\n% note\n\n3 4 3\n1 1 2.5\n3 4 -1\n1 1 7\n"


def write(tmp_path, text):
    path = tmp_path / "a.mtx"
    path.write_text(text)
    return str(path)


def both(spark, path):
    spark.dataSource.register(mtx.MtxDataSource)
    found = [sorted(map(tuple, f.collect())) for f in (mtx.read_mtx(spark, path), spark.read.format("mtx").option("partitionBytes", 7).load(path))]
    assert found[0] == found[1]
    return found[0]


def test_matrix_market(spark, tmp_path):
    assert both(spark, write(tmp_path, GOOD)) == [(0, 0, 2.5), (0, 0, 7.0), (2, 3, -1.0)]
    assert both(spark, write(tmp_path, "%%matrixmarket matrix coordinate pattern symmetric\n2 2 2\n1 1\n2 1\n")) == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0)]
    assert both(spark, write(tmp_path, "%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n2 1 3\n")) == [(0, 1, -3.0), (1, 0, 3.0)]


@pytest.mark.parametrize(
    "text, why",
    [
        ("", "no lines"),
        ("hello\n1 1 0\n", "'hello'"),
        (GOOD.replace("coordinate", "array"), "'array'"),
        (GOOD.replace("real", "complex"), "'complex'"),
        (GOOD.replace("general", "hermitian"), "'hermitian'"),
        ("%%MatrixMarket matrix coordinate real general\n% x\n", "no size line"),
        (GOOD.replace("3 4 3", "3 x 3"), "'3 x 3'"),
        (GOOD.replace("3 4 3", "0 4 3"), "'0 4 3'"),
        (GOOD.replace("3 4 3", "3 4000000000 3"), "4000000000"),
        (GOOD.replace("3 4 -1", "3 z -1"), "3 z -1"),
        (GOOD.replace("3 4 -1", "3 5 -1"), "outside 3 x 4.*3 5 -1"),
        (GOOD.replace("3 4 3", "3 4 5"), "5 entries declared, 3 found"),
    ],
)
def test_matrix_market_errors(spark, tmp_path, text, why):
    path = write(tmp_path, text)
    with pytest.raises(ValueError, match=why):
        mtx.read_mtx(spark, path)
    spark.dataSource.register(mtx.MtxDataSource)
    with pytest.raises(Exception, match=why):
        spark.read.format("mtx").option("partitionBytes", 7).load(path).collect()


def test_matrix_market_ignores_what_follows_and_round_trips(spark, tmp_path):
    path = write(tmp_path, GOOD.replace("3 4 3", "3 4 2"))
    cells = mtx.read_mtx(spark, path)
    assert both(spark, path) == [(0, 0, 2.5), (2, 3, -1.0)]
    mtx.write_mtx(cells.coalesce(1), 3, 4, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == sorted(["%%MatrixMarket matrix coordinate real general", "3 4 2", "1 1 2.5", "3 4 -1.0"])


def test_matrix_market_folder_is_read_by_file_name(spark, tmp_path):
    cells = spark.range(900).selectExpr("id div 30 r", "cast(id % 30 as int) c", "cast(id as float) v")
    expected = sorted(map(tuple, cells.collect()))
    for k, made in enumerate((cells.coalesce(1), cells.repartition(5), cells.repartitionByRange(7, "r"), cells.orderBy("r").where("r % 2 = 0").union(cells.where("r % 2 = 1")))):
        mtx.write_mtx(made, 30, 30, path := str(tmp_path / f"m{k}"))
        assert sorted(map(tuple, mtx.read_mtx(spark, path).collect())) == expected
    folder = tmp_path / "by_hand"  # the head is in the smallest file, entries in its file and beyond the declared ones are in others
    folder.mkdir()
    (folder / "a").write_text("%%MatrixMarket matrix coordinate real general\n% x\n")
    (folder / "b").write_text("\n30 30 8\n30 30 8\n")
    (folder / "c").write_text("".join(f"1 {i} 1\n" for i in range(1, 6)))
    (folder / "d").write_text("% more\n" + "".join(f"2 {i} 1\n" for i in range(1, 31)))
    (folder / "e").write_text("7 x\n" * 40)
    found = sorted(map(tuple, mtx.read_mtx(spark, str(folder)).collect()))
    assert found == [*((0, i, 1.0) for i in range(5)), (1, 0, 1.0), (1, 1, 1.0), (29, 29, 8.0)]


def test_matrix_market_lines_across_splits(spark, tmp_path):
    path = write(tmp_path, "%%MatrixMarket matrix coordinate real general\n" + "% x\n" * 30 + "99 9 500\n" + "".join(f"{i % 99 + 1} {i % 9 + 1} {i}\n" for i in range(700)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for n in ("41", "100", "1000", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", n)
            assert sorted(map(tuple, mtx.read_mtx(spark, path).collect())) == sorted((i % 99, i % 9, float(i)) for i in range(500))
            folder = tmp_path / f"in{n}"  # the head in a file of its own, entries of the second file not all declared
            folder.mkdir()
            for k, text in enumerate(("%%MatrixMarket matrix coordinate real general\n99 9 150\n", *["".join(f"{i % 99 + 1} {i % 9 + 1} {i + 100 * k}\n" for i in range(100)) for k in range(2)])):
                (folder / str(k)).write_text(text)
            assert sorted(map(tuple, mtx.read_mtx(spark, str(folder)).collect())) == sorted((i % 99, i % 9, float(i + 100 * k)) for k in range(2) for i in range(100 if k == 0 else 50))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def degrees(frame):
    return [r.nnz for r in frame.orderBy("r").collect()]


def test_golden_degrees(spark):
    assert degrees(synthetic.clustered_degrees(spark, 8, 4)) == [8, 8, 2, 2, 2, 2, 2, 2]
    assert degrees(synthetic.spike_degrees(spark, 12, 4, 2.0, 2)) == [8 if r in (4, 8) else 3 for r in range(12)]
    assert degrees(synthetic.powerlaw_degrees(spark, 8, 2)) == [6, 3, 2, 1, 1, 1, 1, 1]
    assert degrees(synthetic.uniform_degrees(spark, 5, 3)) == [3] * 5


def test_entries_follow_the_stream(spark):
    got = [tuple(r) for r in synthetic.matrix(spark, "spike", 12, 4, contrast=2.0, spikes=2).orderBy("r", "k").collect()]
    state, expected = 12345, []
    for r in range(12):
        for k in range(8 if r in (4, 8) else 3):
            state = (state * 1664525 + 1013904223) % 2**32
            c = state % 12
            state = (state * 1664525 + 1013904223) % 2**32
            expected.append((r, k, c, float(np.float32(0.5 + state % 100 * 0.01))))
    assert got == expected


def test_jumps():
    state = 12345
    for n in range(1, 50):
        state = (state * 1664525 + 1013904223) % 2**32
        factor, offset = jump(n)
        assert (factor * 12345 + offset) % 2**32 == state


def test_spmv_equals_serial(spark):
    cells = synthetic.matrix(spark, "clustered", 60, 5)
    rows = cells.collect()
    y = np.zeros(60)
    for r in rows:
        y[r.r] += r.v * (1 + (r.c & 3) * 0.25)
    got = {r.r: r.y for r in kernels.spmv(cells).collect()}
    assert all(kernels.close(got[r], y[r], 1e-4) for r in range(60))
    packed = {r.r: (r["cols"], r["vals"]) for r in attach.csr_rows(cells, "k").collect()}
    assert packed[3][0] == [r.c for r in sorted(rows, key=lambda r: r.k) if r.r == 3]


def test_spaces(spark):
    assert space.size([0, 2], [3, 2]) == 0 and space.size([], []) == 0 and space.size([0, 0], [2**40, 2**40]) == 0 and space.size([1, 2], [4, 6]) == 12
    assert space.loop_nd(spark, [0, 5], [3, 4], ["a", "b"]).count() == 0 and space.loop(spark, -3).count() == 0
    ids = spark.createDataFrame([(-5,), (0,), (11,)], "i long")
    a, b = space.decode(ids.i, [3, 4])
    assert [tuple(r) for r in ids.select(a, b, space.encode([a, b], [3, 4])).collect()] == [(0, 0, 0), (0, 0, 0), (2, 3, 11)]
    for total, parts in ((10, 3), (3, 5), (200, 8), (1, 1)):
        from rangeflow.operators.cuts import balanced

        spans = balanced(total, parts)
        got = [r[0] for r in space.loop(spark, total).orderBy("i").select(space.owner(space.F.col("i"), total, parts)).collect()]
        assert got == [p for p in range(parts) for _ in range(spans[p + 1] - spans[p])]


def test_reductions(spark):
    rows = spark.createDataFrame([(1, 2), (1, None), (2, 5)], "g int, v int")
    found = [reduce.Accumulator(op, "v", op, "int") for op in reduce.OPS]
    assert [tuple(r) for r in reduce.reduce(rows, found).collect()] == [(7, 10.0, 5, 2)]
    parts = reduce.reduce(rows, found, ["g"])
    assert tuple(reduce.combine(parts, found).first()) == (7, 10.0, 5, 2)
    empty = rows.where("g > 9")
    for kind in reduce.LIMITS:
        got = reduce.reduce(empty, [reduce.Accumulator(op, "v", op, kind) for op in reduce.OPS]).first()
        assert [float(x) for x in got] == [float(reduce.identity(op, kind)) for op in reduce.OPS]
    for bad in (("sum", "text"), ("avg", "int")):
        with pytest.raises(ValueError):
            reduce.identity(*bad)
    zero = spark.createDataFrame([(0.0,)], "x double")
    assert reduce.scaled_by_norm(zero, "x").first().y == 0.0


def test_bindings(spark):
    vector = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, v double")
    with pytest.raises(ValueError):
        attach.attach(space.loop(spark, 2), vector, attach.Access.SHARED_ALL, result=True)
    assert attach.attach(space.loop(spark, 2), vector).count() == 2
    matrix = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0])], "i long, row array<double>")
    assert sorted(map(tuple, attach.to_rows(attach.to_long(matrix)).collect())) == [(0, [1.0, 2.0]), (1, [3.0])]
    assert [r.v for r in attach.gather(vector, vector.where("i = 1").selectExpr("i", "v * 10 v"), "v").orderBy("i").collect()] == [1.0, 20.0]
    assert attach.output(vector, "out").first().out == 0.0


def test_transfer_with_an_idle_source(spark):
    work = spark.createDataFrame([(0, 30), (1, 0), (2, 70)], "rank int, remaining long")
    parts = spark.createDataFrame([(0, 0, 50), (1, 50, 100)], "part int, s long, e long")
    assert sorted(map(tuple, ranges.transfer_plan(work, parts).collect())) == [(0, 0, 0, 30), (2, 0, 30, 20), (2, 1, 50, 50)]


def test_steps_conserve_and_cut(spark, tmp_path):
    n, steps, cuts_made = 300, 5, []
    field = kernels.heat_initial(space.loop(spark, n), n)

    def cut(frame):
        cuts_made.append(1)
        path = str(tmp_path / f"f{len(cuts_made)}")
        frame.write.parquet(path)
        return spark.read.parquet(path)

    out = run_steps(field, steps, lambda f: kernels.stencil_step(f, n, block=64), 2, cut)
    u = 1.0 + np.sin(6.2831853 * np.arange(n) / n)
    for _ in range(steps):
        u = u + 0.25 * (np.roll(u, 1) - 2 * u + np.roll(u, -1))
    got = [r.u for r in out.orderBy("i").collect()]
    assert np.allclose(got, u, rtol=1e-12) and len(cuts_made) == 2 and kernels.close(sum(got), u.sum(), 1e-6)


@pytest.mark.parametrize("n, block", [(1, 4), (2, 4), (4, 4), (5, 4), (8, 4)])
def test_small_rings(spark, n, block):
    field = space.loop(spark, n).selectExpr("i", "cast(i * i as double) u")
    u = np.arange(n) ** 2.0
    got = [r.u for r in kernels.stencil_step(field, n, block=block).orderBy("i").collect()]
    assert np.allclose(got, u + 0.25 * (np.roll(u, 1) - 2 * u + np.roll(u, -1)))


def test_mem_kernel(spark):
    x, total = (5 + 1) * 6364136223846793005 + 1442695040888963407 & 2**64 - 1, 0.0
    for _ in range(10):
        x = x * 6364136223846793005 + 1442695040888963407 & 2**64 - 1
        total += ((x >> 33) % 64 * 2654435761) % 1000 * 0.001
    got = {r.i: r.c for r in kernels.mem_kernel(space.loop(spark, 8), 10, 64).collect()}
    assert kernels.close(got[5], total, 1e-9)


def test_configuration(spark, caplog):
    spark.conf.set("spark.rangeflow.quorum", "0.4")
    spark.conf.set("spark.rangeflow.cost_step", "4")
    spark.conf.set("spark.rangeflow.balancing", "maybe")
    try:
        found = conf.load(spark, epoch_ms=50)
    finally:
        for k in ("quorum", "cost_step", "balancing"):
            spark.conf.unset("spark.rangeflow." + k)
    assert (found.quorum, found.cost_step, found.balancing, found.epoch_ms) == (1.0, 4, False, 50)
    assert len([r for r in caplog.records if "spark.rangeflow" in r.message]) == 2
    assert conf.parse_args(["--n=5", "--x=a", "--f=1.5", "n=7"], {"n": 1, "f": 0.0}) == {"n": 5, "f": 1.5}


def test_trace_rows(spark):
    waves = Controller(4, conf.Conf(elastic=True, policy="fixed", sequence="2,4"), speed=lambda e, r, n: 10.0).waves(150)
    rows = trace.trace_rows(spark, waves)
    counts = {r.tag: r["count"] for r in rows.groupBy("tag").count().collect()}
    assert counts["RESIZE"] == 2 and counts["START"] == counts["END"] == sum(w.size for w in waves)
    assert all(r.value.split(",")[0] in counts for r in trace.as_csv(rows).collect())
    assert trace.timing_rows(spark, {"init": 0.5}).first().value == 0.5


def test_probes_and_workers_of_each_wave(spark):
    waves = Controller(4, conf.Conf(elastic=True, policy="auto", min_horizon_epochs=0.0), speed=lambda e, r, n: 10.0).waves(400)
    rows = trace.trace_rows(spark, waves)
    probes = rows.where("tag = 'PROBE'").orderBy("epoch").collect()
    assert len(probes) == len(waves) and probes[-1].thr1 == 10.0 and abs(probes[-1].eff * probes[-1].old - probes[-1].speedup) < 1e-9
    assert [r.rank for r in rows.where("tag = 'START' and epoch = 0").orderBy("rank").collect()] == list(range(waves[0].size))
    assert trace.trace_rows(spark, waves, probes=False).where("tag = 'PROBE'").count() == 0


def test_thread_rows(spark):
    spark.range(1000).repartition(3).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    last = max(s for j in spark.sparkContext.statusTracker().getJobIdsForGroup(None) for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds)
    rows = trace.thread_rows(spark, last).collect()
    assert [r.rank for r in rows] == [0, 1, 2] and all(r.tag == "TM" and r.run_ms >= 0 and r.shuffle_read > 0 for r in rows)


def test_one_worker_logs(spark):
    record = lambda rank: trace.logging.makeLogRecord({"rank": rank})
    trace.set_level(conf.Conf(log_level="WARNING"))
    assert trace.log.filter(record(0)) and not trace.log.filter(record(3)) and trace.log.level == trace.logging.WARNING
    trace.set_level(conf.Conf(log_all_workers=True))
    assert trace.log.filter(record(3)) and len([f for f in trace.log.filters if isinstance(f, trace.OneWorker)]) == 1


@pytest.mark.parametrize("n, block, depth, steps", [(1, 4, 2, 3), (7, 100, 5, 12), (40, 10, 4, 11), (45, 10, 10, 25), (64, 16, 3, 7)])
def test_many_steps_equal_single_ones(spark, n, block, depth, steps):
    u = np.arange(n) ** 2.0 % 17
    field = spark.createDataFrame([(i, float(x)) for i, x in enumerate(u)], "i long, u double")
    for _ in range(steps):
        u = u + 0.25 * (np.roll(u, 1) - 2 * u + np.roll(u, -1))
    got = [r.u for r in kernels.stencil_many(field, n, steps, lambda f: f, block=block, depth=depth).orderBy("i").collect()]
    assert np.allclose(got, u)


def test_user_aggregates_of_nothing(spark):
    how = reduce.UserAggregate((0.0,), lambda s, v: (s[0] + float(v.sum()),), lambda a, b: (a[0] + b[0],))
    rows = spark.createDataFrame([(1.0,), (None,), (2.5,)], "x double")
    assert reduce.reduce_user(rows, "x", how).first().state == [3.5]
    assert reduce.reduce_user(rows.limit(0), "x", how).first().state == [0.0]
