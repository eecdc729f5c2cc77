"""One sizing decision from the votes of the active workers.

Unanimous votes decide without a quorum. Otherwise enough workers must take
part (turnout), one side (grow, shrink, rebalance) must have its quorum, and
its target is the median of its votes, of the two middle ones that nearer the
current size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, RESIZE, ABSTAIN = "KEEP", "RESIZE", "ABSTAIN"
_EPS = 1e-9


@dataclass(frozen=True)
class Decision:
    """A worker's vote."""

    vote: str = KEEP
    target: int = -1
    done: bool = False
    settled: bool = False
    next_epoch_ms: int = 0
    skip_cooldown: bool = False


@dataclass(frozen=True)
class Outcome:
    """What all votes come to; ``target`` is -1 where nothing changes."""

    target: int = -1
    done: bool = False
    next_epoch_ms: int = 0
    skip_cooldown: bool = False

    @property
    def resize(self) -> bool:
        return self.target > 0


def normalised(vote: Column, target: Column, active: Column, universe: Column, rebalance_cooldown: Column) -> tuple[Column, Column]:
    """Vote and target as they count: unknown votes and bad targets abstain, targets stay in the universe."""
    known = F.when(vote.isin(KEEP, RESIZE, ABSTAIN), vote).otherwise(ABSTAIN)
    counted = F.when((known == RESIZE) & (F.coalesce(target, F.lit(0)) <= 0), ABSTAIN).when((known == RESIZE) & (target == active) & (rebalance_cooldown > 0), KEEP).otherwise(known)
    return counted, F.when(counted == RESIZE, F.least(target, universe)).otherwise(-1)


def consensus(votes: DataFrame, by: Sequence[str], quorum: float = 1.0, turnout: float = 0.5) -> DataFrame:
    """One row a group: voters by side, side, target (-1: no change), next_epoch_ms, skip_cooldown.

    votes: the columns of ``by`` and vote, target, active_n, next_epoch_ms,
    skip_cooldown; already normalised. A single aggregate; the medians are
    discrete percentiles, ascending for growing and descending otherwise.
    """
    t, a = F.col("target"), F.col("active_n")
    resize = F.col("vote") == RESIZE
    side = F.when(~resize, None).when(t > a, "grow").when(t < a, "shrink").otherwise("rebalance")
    rows = votes.withColumn("side", side)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    middle = lambda name, order: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN side = '{name}' THEN target END {order})")
    found = rows.groupBy(*by).agg(
        count(F.col("vote") == KEEP).alias("n_keep"),
        count(F.col("vote") == ABSTAIN).alias("n_abstain"),
        count(F.col("side") == "grow").alias("n_grow"),
        count(F.col("side") == "shrink").alias("n_shrink"),
        count(F.col("side") == "rebalance").alias("n_rebalance"),
        ((F.min("vote") == F.max("vote")) & (F.min("target") == F.max("target"))).alias("unanimous"),
        F.max("vote").alias("any_vote"),
        F.max("target").alias("any_target"),
        F.max("active_n").alias("active_n"),
        middle("grow", "ASC").alias("grow_to"),
        middle("shrink", "DESC").alias("shrink_to"),
        F.max("next_epoch_ms").alias("next_epoch_ms"),
        F.min("skip_cooldown").alias("skip_cooldown"),
    )
    voters = F.col("n_keep") + F.col("n_grow") + F.col("n_shrink") + F.col("n_rebalance")
    enough = (voters > 0) & (voters >= F.ceil(turnout * (voters + F.col("n_abstain")) - _EPS))
    need = F.greatest(F.floor(voters / 2) + 1, F.ceil(quorum * voters - _EPS))
    by_votes = (
        F.when(~enough, -1)
        .when(F.col("n_grow") >= need, F.col("grow_to"))
        .when(F.col("n_shrink") >= need, F.col("shrink_to"))
        .when(F.col("n_rebalance") >= need, F.col("active_n"))
        .otherwise(-1)
    )
    target = F.when(F.col("unanimous"), F.when(F.col("any_vote") == RESIZE, F.col("any_target")).otherwise(-1)).otherwise(by_votes)
    return found.withColumn("decided", target.cast("int")).select(*by, "active_n", "n_keep", "n_abstain", "n_grow", "n_shrink", "n_rebalance", "unanimous", F.col("decided").alias("target"), "next_epoch_ms", "skip_cooldown")


def decide(votes: Sequence[Decision], active: int, quorum: float = 1.0, turnout: float = 0.5) -> Outcome:
    """:func:`consensus` of one group in memory (the controller has a vote a worker)."""
    if any(v.done for v in votes) or not votes:
        return Outcome(done=True)
    late = max(v.next_epoch_ms for v in votes)
    skip = all(v.skip_cooldown for v in votes)
    outcome = lambda target: Outcome(target, False, late, skip)
    if len({(v.vote, v.target) for v in votes}) == 1:
        return outcome(votes[0].target if votes[0].vote == RESIZE else -1)
    targets = sorted(v.target for v in votes if v.vote == RESIZE)
    voters = sum(v.vote != ABSTAIN for v in votes)
    if not voters or voters < math.ceil(turnout * len(votes) - _EPS):
        return outcome(-1)
    need = max(voters // 2 + 1, math.ceil(quorum * voters - _EPS))
    for mine, place in (([t for t in targets if t > active], lambda n: (n - 1) // 2), ([t for t in targets if t < active], lambda n: n // 2), ([t for t in targets if t == active], lambda n: n // 2)):
        if len(mine) >= need:
            return outcome(mine[place(len(mine))])
    return outcome(-1)
