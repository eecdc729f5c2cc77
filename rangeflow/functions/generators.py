"""The 32-bit linear congruential stream, sequentially and by jumps."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the stream: multiplier, increment, modulus.
MULTIPLIER, INCREMENT, MASK = 1664525, 1013904223, (1 << 32) - 1


def lcg_next(state: Column) -> Column:
    """The state after ``state`` (longs below 2**32)."""
    return (state * MULTIPLIER + INCREMENT).bitwiseAND(MASK)


def _affine(state: Column, factor: Column, offset: Column) -> Column:
    """factor * state + offset below 2**32; halves keep every product below 2**63."""
    high, low = F.shiftright(state, 16), state.bitwiseAND(0xFFFF)
    product = (high * factor).bitwiseAND(0xFFFF) * 65536 + low * factor
    return (product.bitwiseAND(MASK) + offset).bitwiseAND(MASK)


def jump(steps: int) -> tuple[int, int]:
    """(factor, offset) of ``steps`` steps: state -> factor * state + offset."""
    factor, offset, f, o = 1, 0, MULTIPLIER, INCREMENT
    while steps:
        if steps & 1:
            factor, offset = factor * f & MASK, (offset * f + o) & MASK
        f, o = f * f & MASK, (o * f + o) & MASK
        steps >>= 1
    return factor, offset


def _digits(seed: int, bits: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(lowest bit, factors, offsets) for twelve bits of a position at a time."""
    for low in range(0, bits, 12):
        maps = [jump(d << low) for d in range(1 << 12)]
        yield low, [f for f, _ in maps], [(f * (seed & MASK) + o) & MASK if low == 0 else o for f, o in maps]


def _pick(values: list[int], position: Column, low: int) -> Column:
    digit = F.shiftright(position, low).bitwiseAND(4095).cast("int")
    return F.coalesce(F.get(F.lit(values), digit), F.lit(0))  # never null, which spares filters


def lcg_at(seed: int, position: Column, bits: int = 36) -> Column:
    """The state after ``position`` steps from one seed, in closed form for each row.

    Twelve bits of the position at a time look up the affine map of so many steps, so any
    row of a long stream is worked out alone, in generated code: nothing runs in sequence.
    """
    state = None
    for low, factors, offsets in _digits(seed, bits):
        at = _pick(offsets, position, low)
        state = at if state is None else _affine(state, _pick(factors, position, low), at)
    return state


def with_lcg(df: DataFrame, position: Column, out: str, seed: int, bits: int = 36) -> DataFrame:
    """``df`` with :func:`lcg_at` as a column, a step a projection: none is computed twice."""
    df = df.withColumn("_position", position)
    at = F.col("_position")
    for low, factors, offsets in _digits(seed, bits):
        step = _pick(offsets, at, low)
        df = df.withColumn(out, step if low == 0 else _affine(F.col(out), _pick(factors, at, low), step))
    return df.drop("_position")


def lcg_fold(seed: Column, steps: int) -> Column:
    """The state after ``steps`` steps, one at a time."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), seed.cast("long"), lambda s, _: lcg_next(s))


def unit(state: Column) -> Column:
    """A state as a number in [0, 1)."""
    return state / F.lit(float(1 << 32))
