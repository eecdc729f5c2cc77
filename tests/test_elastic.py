"""The elastic executor against a simulation that deals single indexes."""

from fractions import Fraction

import numpy as np
import pytest

from rangeflow.conf import Conf
from rangeflow.operators import cuts, ranges
from rangeflow.operators.attach import Access
from rangeflow.operators.reduce import Accumulator
from rangeflow.plans import catalog
from rangeflow.plans.controller import Controller, Steps, Worker, exchange


def simulate(total, universe, sizes, speed, balancing, epochs):
    """Waves as lists of indexes a rank; ``sizes`` are those after each wave, exact arithmetic throughout."""
    size, out = sizes[0], []
    edges = np.cumsum([0] + [total // size + (r < total % size) for r in range(size)]).tolist()
    held = [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)] + [[]] * (universe - size)
    done, elapsed = [0] * universe, [Fraction(0)] * universe
    for epoch in range(epochs):
        if not any(held):
            break
        ran = {}
        for r in range(size):
            v = Fraction(speed(epoch, r, size))
            n = int(v)
            ran[r], held[r] = held[r][:n], held[r][n:]
            done[r] += len(ran[r])
            elapsed[r] += len(ran[r]) / v
        moved, target = [], size
        if epoch + 1 < len(sizes) and sizes[epoch + 1] is not None and any(held):
            target = sizes[epoch + 1]
            owner = [(i, r) for r in range(universe) for i in held[r]]
            usual = sum(elapsed) / sum(done)
            density = [elapsed[r] / done[r] if done[r] else usual for r in range(universe)]
            whole, new = sum(d * len(own) for d, own in zip(density, held, strict=True)), [[] for _ in range(universe)]
            if balancing:
                limits = []
                for part in range(1, target):
                    wanted, cost, rows = whole * part / target, Fraction(0), 0
                    for r in range(universe):
                        mine = density[r] * len(held[r])
                        if cost + mine >= wanted or r == size - 1:
                            limits.append(rows + int((wanted - cost) / density[r] + Fraction(1, 2)))
                            break
                        cost, rows = cost + mine, rows + len(held[r])
                limits = [0, *limits, len(owner)]
            else:
                limits = cuts.balanced(len(owner), target)
            for part, (a, b) in enumerate(zip(limits, limits[1:], strict=False)):
                new[part] = [i for i, _ in owner[a:b]]
                moved += [(r, part, i) for i, r in owner[a:b]]
            held, done, elapsed = new, [0] * universe, [Fraction(0)] * universe
        out.append((epoch, size, ran, moved))
        size = target
    return out


def runs(indexes):
    """Sorted indexes as ranges."""
    out = []
    for i in sorted(indexes):
        if out and out[-1][1] == i:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    return [tuple(x) for x in out]


def spans_of(waves):
    return sorted((w.epoch, r, a, b) for w in waves for r, a, b in w.spans)


SCENES = {
    "resize_demo": (20_000, catalog.resize_scene(), [8, 2, 6, 3]),
    "custom_policy": (50_000, catalog.custom_scene(), None),
    "wave_invariance": (3_000, catalog.auto_scene(), None),
}


@pytest.mark.parametrize("name", list(SCENES))
def test_waves_deal_what_a_simulation_of_single_indexes_deals(name):
    total, run, sizes = SCENES[name]
    waves = run.waves(total)
    if sizes is None:  # the policy's own decisions, which other tests check
        sizes = [waves[0].size] + [w.outcome.target if w.outcome.resize else None for w in waves]
    expected = simulate(total, run.universe, sizes, run.speed, run.conf.balancing, 10_000)
    assert [w.size for w in waves] == [s for _, s, _, _ in expected]
    assert spans_of(waves) == sorted((e, r, a, b) for e, _, ran, _ in expected for r, own in ran.items() for a, b in runs(own))
    for w, (_, _, _, moved) in zip(waves, expected, strict=True):
        assert sorted((t.old, t.new, i) for t in w.transfers for i in range(t.start, t.end)) == sorted(moved)
    assert spans_of(waves) == sorted(catalog.SPANS[name])


def test_history_is_that_of_the_waves():
    waves = catalog.resize_scene().waves(20_000)
    found = [x[:6] + (x[7],) for w in waves for x in w.history() if x[1] in catalog.HISTORY_KINDS]
    assert sorted(found, key=repr) == sorted(catalog.RESIZE_HISTORY, key=repr)


def test_exchange_frame_equals_lists(spark):
    held = [[(0, 30), (50, 60)], [], [(100, 170)]]
    cut = [0, 20, 55, 110]
    _, moves = exchange(held, cut)
    frame = spark.createDataFrame([(r, k, a, b) for r, own in enumerate(held) for k, (a, b) in enumerate(own)], "rank int, ord int, s long, e long")
    parts = spark.createDataFrame([(p, a, b) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False))], "part int, s long, e long")
    got = {tuple(r) for r in ranges.exchange(frame, parts).collect()}
    assert got == {(t.old, t.new, t.start, t.end, t.kind) for t in moves}
    alone = spark.createDataFrame([(2, 0, 0, 100)], "rank int, ord int, s long, e long")
    assert {r.kind for r in ranges.exchange(alone, parts).collect()} == {"scatter", "keep"}


def test_measured_runs_cover_once(spark):
    conf = Conf(elastic=True, policy="fixed", sequence="2,4,3", balancing=True, epoch_ms=50)
    run = Controller(4, conf, first=3000).run(spark, 60_000, lambda s: s.selectExpr("i", "wave", "rank", "i * 2 v"), [Accumulator("total", "v"), Accumulator("top", "v", "max")])
    got = run.values.selectExpr("count(*) n", "count(distinct i) d", "sum(v) v").first()
    assert tuple(got) == (60_000, 60_000, 60_000 * 59_999) and tuple(run.reductions.first()) == (60_000 * 59_999, 119_998)
    resizes = [r.other for r in run.history.where("kind = 'resize'").orderBy("epoch").collect()]
    assert resizes == [2, 4, 3][: len(resizes)] and resizes
    assert run.history.where("kind = 'ran'").selectExpr("sum(end - start)").first()[0] == 60_000
    assert run.history.where("kind = 'ran' and value <= 0").count() == 0 and run.timers["map"] > 0


def test_partials_are_carried_in_one_row(spark):
    run = Controller(2, Conf(), speed=lambda e, r, n: 4.0).run(spark, 600, lambda s: s.select("i"), [Accumulator("total", "i")])
    assert run.epochs == 75 and run.reductions.first().total == 600 * 599 // 2


def test_nothing_to_do_and_no_progress(spark):
    run = Controller(3, speed=lambda *_: 1.0).run(spark, 0, lambda s: s.select("i"), [Accumulator("total", "i")])
    assert run.values.count() == 0 and run.reductions.first().total == 0
    with pytest.raises(RuntimeError, match="progress"):
        Controller(3, speed=lambda *_: 0.0).waves(10)


def test_caches_advance_and_outlive_inactivity():
    w = Worker()
    assert not w.give([(0, 100)]) and w.cache == (0, 100)
    assert w.take(30) == [(0, 30)] and w.cache == (30, 100)
    assert w.give([]) and w.cache == (30, 100)
    assert w.give([(40, 60), (80, 100)]) and not w.give([(20, 60)]) and w.cache == (20, 60)


def test_joiners_receive_what_they_lack():
    run = Controller(4, Conf(elastic=True, policy="fixed", sequence="4,2,4", initial_size=2), speed=lambda *_: 10.0, buffers={"x": Access.SHARED_ACTIVE, "y": Access.SHARED_ALL})
    waves = run.waves(1000)
    assert [w.refreshed for w in waves if w.outcome.resize] == [[(2, "x"), (3, "x")], [], [(2, "x"), (3, "x")]]
    assert [w.activity for w in waves if w.outcome.resize] == [[(2, "active"), (3, "active")], [(2, "inactive"), (3, "inactive")], [(2, "active"), (3, "active")]]


def test_horizons_count_as_remaining():
    once, often = (Controller(2, speed=lambda *_: 10.0, horizon=h).waves(100)[0].metrics for h in (1, 4))
    assert (once.remaining, once.iterative) == (80.0, False) and (often.remaining, often.iterative) == (380.0, True)


def test_steps_evaluate_every_so_often_until_settled(spark):
    conf = Conf(elastic=True, policy="cost", step_epoch=2, cost_step=2, cost_measurements=1, initial_size=4)
    field = spark.range(4).selectExpr("id i", "cast(id as double) u")
    _, rows = Steps(4, 4, conf, speed=lambda n: 100.0 * n * (6 - n)).run(field, 60, lambda f: f, lambda f: f)
    due = [r.step for r in rows if r.evaluated]
    assert due[-1] == 60 and due[0] == 2 and len(due) < 20  # settled long before the end
    assert rows[-1].remaining == 0.0 and {r.size for r in rows} >= {2, 4}
