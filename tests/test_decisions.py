"""Cuts, consensus, policies and the controller against golden values and invariants."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rangeflow.conf import Conf
from rangeflow.operators import consensus, cuts
from rangeflow.operators.epoch import EpochMetrics, horizon_is_short
from rangeflow.plans import policies
from rangeflow.plans.catalog import SCENARIOS
from rangeflow.plans.controller import Controller, Cooldown


def test_golden_cuts():
    assert cuts.balanced(10, 3) == [0, 4, 7, 10]
    assert cuts.balanced(200, 8) == list(range(0, 201, 25))
    assert cuts.balanced(3, 5) == [0, 1, 2, 3, 3, 3]
    assert cuts.balanced(0, 4) == [0] * 5
    assert cuts.weighted(10, [1, 1, 1], 3) == [0, 4, 7, 10]
    assert cuts.weighted(100, [0.5, 0.3, 0.2], 3) == [0, 50, 80, 100]
    assert cuts.weighted(7, [0.9, 0.05, 0.05], 3) == [0, 5, 6, 7]
    assert cuts.weighted(10, [0, 0], 2) == [0, 5, 10]
    assert cuts.weighted(10, [3, 1], 2, balancing=False) == [0, 5, 10]
    assert cuts.cost_cuts_of([50, 50, 0, 0], [50, 10, 0, 0], [1, 1, 0, 0], 4) == [0, 55, 70, 85, 100]
    assert cuts.updated_weights([3.0, 1.0, 9.0], 3, 2) == [0.75, 0.25, 0.0]
    assert cuts.updated_weights([3.0, 1.0, 0.0], 2, 3) == [1 / 3] * 3


@settings(max_examples=200)
@given(st.integers(0, 500), st.lists(st.floats(0, 100), min_size=1, max_size=12))
def test_weighted_cuts_cover(total, weights):
    found = cuts.weighted(total, weights, len(weights))
    sizes = [b - a for a, b in zip(found, found[1:], strict=False)]
    assert found[0] == 0 and found[-1] == total and min(sizes) >= 0
    if total >= len(weights):
        assert min(sizes) >= 1


@settings(max_examples=200)
@given(st.lists(st.tuples(st.integers(0, 300), st.floats(0, 50), st.floats(0, 5)), min_size=1, max_size=10), st.integers(1, 12))
def test_cost_cuts_ascend(rows, target):
    found = cuts.cost_cuts_of(*[list(x) for x in zip(*rows, strict=True)], target)
    assert len(found) == target + 1 and found[0] == 0 and found[-1] == sum(r[0] for r in rows) and found == sorted(found)


def test_cost_cuts_frame_equals_lists(spark):
    rng = random.Random(3)
    for target in (1, 2, 4, 7):
        rows = [(r, rng.randrange(100), float(rng.randrange(3) * 10), rng.random()) for r in range(5)]
        frame = spark.createDataFrame(rows, "rank int, remaining long, done double, elapsed double")
        got = [r.cut for r in cuts.cost_cuts(frame, target).orderBy("part").collect()]
        assert got == cuts.cost_cuts_of([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], target)


def test_golden_consensus():
    for name, active, votes, quorum, size in SCENARIOS:
        cast = [consensus.Decision(consensus.ABSTAIN) if t < 0 else consensus.Decision(consensus.RESIZE, t) for t in votes]
        out = consensus.decide(cast, active, quorum)
        assert (out.target if out.resize else active) == size, name


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["KEEP", "RESIZE", "ABSTAIN"]), st.integers(1, 8)), min_size=1, max_size=8), st.integers(1, 8), st.sampled_from([0.51, 0.75, 1.0]))
def test_consensus_frame_equals_lists(spark, votes, active, quorum):
    cast = [consensus.Decision(v, t if v == "RESIZE" else -1) for v, t in votes]
    rows = [(0, d.vote, d.target, active, 0, False) for d in cast]
    frame = spark.createDataFrame(rows, "g int, vote string, target int, active_n int, next_epoch_ms int, skip_cooldown boolean")
    assert consensus.consensus(frame, ["g"], quorum).first().target == consensus.decide(cast, active, quorum).target


def trace(machine, universe, size, throughput, epochs, iterative=False):
    state, out = machine.initial(), []
    for _ in range(epochs):
        m = EpochMetrics(active_n=size, universe=universe, remaining=1e9, throughput=throughput(size), epoch_elapsed=1.0, iterative=iterative)
        phase = state.phase
        state, d = machine.step(state, m)
        size = d.target if d.vote == "RESIZE" else size
        out.append(f"{phase}:{m.active_n}" + (f">{d.target}" if d.vote == "RESIZE" else ""))
    return " ".join(out)


CONF = Conf(elastic=True)
CURVE = lambda n: 100 * n / (1 + 0.1 * (n - 1))


@pytest.mark.parametrize(
    "machine, universe, size, curve, iterative, expected",
    [
        (policies.Search(0.6, CONF), 16, 16, CURVE, False, "IDLE:16>1 NEEDS_BASELINE:1 NEEDS_BASELINE:1 NEEDS_BASELINE:1>16 EXPLORE_MAX:16>8 SEARCHING:8>4 SEARCHING:4>6 SEARCHING:6>7 SEARCHING:7 PROBING:7>8 PROBING:8>7 PROBING:7>8"),
        (policies.Search(0.6, CONF), 8, 1, CURVE, False, "IDLE:1>8 EXPLORE_MAX:8>4 SEARCHING:4>6 SEARCHING:6>7 SEARCHING:7 PROBING:7>8 PROBING:8>7"),
        (policies.Search(0.0, CONF), 8, 8, CURVE, False, "IDLE:8>1 NEEDS_BASELINE:1 NEEDS_BASELINE:1 NEEDS_BASELINE:1>8 EXPLORE_MAX:8 PROBING:8 PROBING:8"),
        (policies.Cost(CONF), 8, 2, lambda n: 100 * min(n, 5), False, "RAMP:2>8 RAMP:8 RAMP:8>7 DESCENT:7>6 DESCENT:6>5 DESCENT:5>4 DESCENT:4>5 SETTLED:5"),
        (policies.Cost(CONF), 32, 32, lambda n: 100 * n * (33 - n), True, "RAMP:32 RAMP:32>24 SAMPLE:24 SAMPLE:24 SAMPLE:24 SAMPLE:24>16 SAMPLE:16 SAMPLE:16 SAMPLE:16 SAMPLE:16>8 SAMPLE:8 SAMPLE:8 SAMPLE:8 SAMPLE:8>16 SETTLED:16"),
    ],
)
def test_golden_policies(machine, universe, size, curve, iterative, expected):
    assert trace(machine, universe, size, curve, len(expected.split()), iterative) == expected


def test_gate_fires_defers_and_gives_up():
    machine = policies.Search(0.0, Conf(elastic=True, balancing=True))
    state = policies.SearchState(phase="PROBING", single=100.0, size=4, low=1, high=8)
    m = EpochMetrics(active_n=4, universe=4, remaining=1e6, throughput=400.0, max_slow_streak=3)
    votes = []
    for _ in range(5):
        state, d = machine.step(state, m)
        votes.append((d.vote, d.target))
    assert votes == [("RESIZE", 4)] * 3 + [("KEEP", -1)] * 2 and state.gate.given_up_at == 4
    fresh = policies.SearchState(phase="PROBING", single=100.0, size=4)
    assert machine.step(fresh, EpochMetrics(active_n=4, universe=4, remaining=1e6, throughput=400.0, max_slow_streak=3, rebalance_cooldown=1))[1] == consensus.Decision()


def test_sequence_custom_and_plugin():
    assert policies.parse_sequence("2,2 4,8,8", 8) == [2, 4, 8]
    for bad in ("", "0", "9", "a", "2,-1"):
        with pytest.raises(ValueError):
            policies.parse_sequence(bad, 8)
    machine = policies.FixedSequence([2, 4])
    steps = [machine.step(None, EpochMetrics(active_n=n, universe=8, commits=c))[1] for n, c in ((8, 0), (2, 0), (2, 1), (4, 2))]
    assert [(d.vote, d.target, d.done) for d in steps] == [("RESIZE", 2, False), ("RESIZE", 4, False), ("RESIZE", 4, False), ("KEEP", -1, True)]
    sample = policies.grow_or_shrink(2, 2)
    uneven = EpochMetrics(active_n=4, universe=5, max_rem_time=2.0, sum_rem_time=4.0)
    assert sample(uneven).target == 5 and sample(EpochMetrics(active_n=3, universe=5, any_settled=True)).target == 2
    assert policies.policy(Conf(policy="math:sqrt"), 4).function(4.0) == 2.0
    for bad in ("math:nothing", "nonsense"):
        with pytest.raises(ValueError):
            policies.policy(Conf(policy=bad), 4)


def test_states_survive_json():
    for machine in (policies.Search(0.6, CONF), policies.Cost(CONF), policies.FixedSequence([1])):
        state = machine.initial()
        for n in (8, 8, 7):
            state, _ = machine.step(state, EpochMetrics(active_n=n, universe=8, remaining=1e6, throughput=10.0, epoch_elapsed=1.0))
            assert policies.restore(machine, policies.dump(state)) == state


def test_votes_are_checked():
    m = EpochMetrics(active_n=4, universe=8, rebalance_cooldown=1)
    check = lambda *a: (lambda d: (d.vote, d.target))(policies.checked_vote(consensus.Decision(*a), m))
    assert check("RESIZE", 99) == ("RESIZE", 8) and check("RESIZE", 0) == ("ABSTAIN", -1) and check("WHAT", 3) == ("ABSTAIN", -1)
    assert check("RESIZE", 4) == ("KEEP", -1) and check("KEEP", 3) == ("KEEP", -1)


def test_cooldowns():
    c = Cooldown()
    c.commit(8, 4, 0.1, 1.0, False)
    assert c.resize == 2
    c.commit(4, 8, 3.5, 1.0, False)
    assert c.resize == 8  # back and forth
    c.commit(8, 8, 0.0, 1.0, False)
    assert c.rebalance == 1 and c.tick() == (True, 1) and c.tick() == (True, 0)
    c.commit(8, 4, 9.0, 1.0, True)
    assert c.resize == 0


def test_horizon():
    assert horizon_is_short(EpochMetrics(active_n=2, remaining=10, throughput=10.0), 2)
    assert not horizon_is_short(EpochMetrics(active_n=2, remaining=10, throughput=10.0, min_throughput=0.1), 2)


@pytest.mark.parametrize("name", ["auto", "throughput", "efficiency", "cost", "fixed"])
def test_waves_cover_once_whatever_the_policy(name):
    conf = Conf(elastic=True, policy=name, sequence="3,5,2", initial_size=4, balancing=True, min_horizon_epochs=0.0)
    run = Controller(8, conf, speed=lambda e, r, n: 5.0 + (r * 7 + e) % 5)
    waves = run.waves(700)
    assert sorted(i for w in waves for _, a, b in w.spans for i in range(a, b)) == list(range(700))
    assert all(1 <= w.size <= 8 and all(0 <= r < w.size for r, _, _ in w.spans) for w in waves)
    for w, after in zip(waves, waves[1:], strict=False):
        assert after.size == (w.outcome.target if w.outcome.resize else w.size)
        ran = {i for x in waves[: w.epoch + 1] for _, a, b in x.spans for i in range(a, b)}
        dealt = [i for t in w.transfers for i in range(t.start, t.end)]
        assert not w.transfers or sorted(dealt) == sorted(set(range(700)) - ran)
    assert [w.size for w in waves] == [w.size for w in run.waves(700)]
    if name == "fixed":
        assert [w.outcome.target for w in waves if w.outcome.resize] == [3, 5, 2]


def test_functions_may_take_the_configuration():
    tunable = lambda m, conf: consensus.Decision(consensus.RESIZE, conf.cost_step)
    assert policies.policy(Conf(cost_step=3), 8, tunable).step(None, EpochMetrics(active_n=1))[1].target == 3
    one = policies.policy(Conf(policy="rangeflow.plans.policies:step_of_one"), 8)
    assert one.step(None, EpochMetrics(active_n=3, universe=8, max_rem_time=2.0, sum_rem_time=3.0))[1].target == 4
    assert one.step(None, EpochMetrics(active_n=3, universe=8, any_settled=True))[1].target == 2


def test_without_elasticity_nothing_changes():
    waves = Controller(6, Conf(policy="auto"), speed=lambda e, r, n: 3.0).waves(200)
    assert {w.size for w in waves} == {6}
