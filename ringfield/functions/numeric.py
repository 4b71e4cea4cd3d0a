"""Scalar column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column) -> Column:
    """Round to the nearest integer, ties to even."""
    return F.rint(value)


def uniform(seed: int, *ids: Column) -> Column:
    """Repeatable draw in [0, 1) from row identity.

    It depends on the ids alone, so a retried task, another partitioning or
    another engine draws the same number; `rand(seed)` gives none of these.
    """
    text = F.concat_ws(":", *[c.cast("string") for c in ids], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def doubles(values: Sequence[float]) -> Column:
    """Constant array column (folded to one literal)."""
    return F.array(*[F.lit(float(v)) for v in values])


def frange(start: float, stop: float, step: float) -> list[float]:
    """Evenly spaced thresholds, `stop` excluded, each the nearest double of start + n*step."""
    count = int(round((stop - start) / step))
    return [round(start + n * step, 10) for n in range(count)]


def count_below(value: Column, thresholds: Sequence[float]) -> Column:
    """How many sorted thresholds are strictly smaller than `value`.

    One number per row replaces one row per threshold: `value <= t[n]` holds
    exactly when `n >= count_below`, so curves come from a histogram and a
    running sum. Evenly spaced thresholds need no search, only a guess
    corrected by comparing with the neighbouring literals.
    """
    grid = [float(t) for t in thresholds]
    if sorted(grid) != grid:
        raise ValueError("thresholds must be sorted")
    literal = doubles(grid)
    size = len(grid)
    step = (grid[-1] - grid[0]) / (size - 1) if size > 1 else 0.0
    even = step > 0 and all(abs(t - (grid[0] + n * step)) < step * 1e-3 for n, t in enumerate(grid))
    if not even:
        return F.size(F.filter(literal, lambda t: t < value))
    raw = F.ceil((value - F.lit(grid[0])) / F.lit(step))
    guess = F.least(F.greatest(raw, F.lit(0)), F.lit(size)).cast("int")
    up = F.coalesce(F.get(literal, guess) < value, F.lit(False))
    down = F.coalesce(F.get(literal, guess - 1) >= value, F.lit(False))
    return guess + F.when(up, 1).when(down, -1).otherwise(0)


def vector_angle(x: Column, y: Column) -> Column:
    """Angle of (x, y) in [0, 2 pi); the zero vector points to 3 pi / 2."""
    turned = F.atan2(y, x)
    folded = F.when(turned < 0, turned + 2 * F.pi()).otherwise(turned)
    return F.when((x == 0) & (y == 0), 1.5 * F.pi()).otherwise(folded)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, low), high)
