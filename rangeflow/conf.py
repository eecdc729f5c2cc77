"""Typed configuration with defaults; values that don't parse warn and fall back.

Keys are ``spark.rangeflow.<name>`` in the session's configuration, so they can be
given to ``spark-submit`` as well as set at run time.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

log = logging.getLogger("rangeflow")

PREFIX = "spark.rangeflow."


@dataclass(frozen=True)
class Conf:
    """Defaults of every key; the type of the default is the type of the key."""

    elastic: bool = False
    resize: bool = True
    balancing: bool = False
    initial_size: int = 0  # 0: the whole universe
    policy: str = "auto"
    quorum: float = 1.0
    turnout: float = 0.5
    epoch_ms: int = 1000
    min_horizon_epochs: float = 2.0
    baseline_per_worker: bool = False
    cost_keep: float = 0.97
    cost_step: int = 8
    cost_refine: bool = False
    cost_measurements: int = 3
    sequence: str = ""
    step_epoch: int = 64
    step_reduces: int = 1
    fast_response: bool = False
    # costs that policies may assume, in seconds
    fixed_cost: float = 0.05
    migration_cost: float = 0.20
    rebalance_cost: float = 0.02
    log_level: str = "INFO"
    log_all_workers: bool = False
    trace: bool = False
    timing: bool = False

    @property
    def resizes(self) -> bool:
        """Sizes can change only where elasticity is on as well."""
        return self.elastic and self.resize


#: Lowest and highest values.
BOUNDS = {
    "quorum": (0.5, 1.0),
    "turnout": (0.0, 1.0),
    "epoch_ms": (1, None),
    "initial_size": (0, None),
    "min_horizon_epochs": (0.0, None),
    "cost_keep": (0.0, 1.0),
    "cost_step": (1, None),
    "cost_measurements": (1, None),
    "step_epoch": (1, None),
    "step_reduces": (0, None),
}

_TRUE, _FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def parse(text: str, kind: type):
    """The whole text as a value of the kind, or ``ValueError``."""
    text = text.strip()
    if kind is bool:
        if text.lower() in _TRUE | _FALSE:
            return text.lower() in _TRUE
        raise ValueError(f"not a boolean: {text!r}")
    if kind is int and not re.fullmatch(r"[+-]?\d+", text):
        raise ValueError(f"not an integer: {text!r}")
    return kind(text)


def checked(name: str, text: str, default):
    """A parsed value within bounds; otherwise a warning and the default."""
    try:
        value = parse(text, type(default))
        low, high = BOUNDS.get(name, (None, None))
        if low is not None and value < low or high is not None and value > high or name == "quorum" and value <= 0.5:
            raise ValueError(f"{value} is out of range")
        return value
    except ValueError as why:
        log.warning("%s%s: %s; using %r", PREFIX, name, why, default)
        return default


def load(spark: SparkSession, **overrides) -> Conf:
    """Configuration of a session, with keyword arguments on top."""
    found = {}
    for f in fields(Conf):
        text = spark.conf.get(PREFIX + f.name, None)
        if text is not None:
            found[f.name] = checked(f.name, text, f.default)
    return replace(Conf(), **found, **overrides)


def parse_args(args: list[str], defaults: dict) -> dict:
    """``--key=value`` arguments over typed defaults; others are left alone."""
    out = dict(defaults)
    for arg in args:
        if (m := re.fullmatch(r"--([A-Za-z]\w*)=(.*)", arg)) and m[1] in defaults:
            out[m[1]] = checked(m[1], m[2], defaults[m[1]])
    return out
