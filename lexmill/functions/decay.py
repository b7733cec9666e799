"""Learning-rate schedules as expressions over a step column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Rates by step limit, the base of the exponential schedule, and the
# amplitude and base of the shrinking one.
MANUAL_RATES = ((3, 1e-3), (7, 1e-4), (None, 1e-5))
EXPONENTIAL_BASE = 0.1
SHRINK_SIZE, SHRINK_BASE = 0.02, 0.5
KINDS = ("manual", "exponential", "step", "time", "constant", "shrinking")


def decay(kind: str, step: Column, lr0: float = 0.1, s: float = 0.5, drop: float = 1.0) -> Column:
    """Rate at ``step``. ``shrinking`` is ``lr0 + 0.02 * 0.5^(1 + t)``."""
    lr, t = F.lit(float(lr0)), step.cast("double")
    if kind == "manual":
        rate = F.lit(MANUAL_RATES[-1][1])
        for limit, value in reversed(MANUAL_RATES[:-1]):
            rate = F.when(step < limit, F.lit(value)).otherwise(rate)
        return rate
    if kind == "exponential":
        return lr * F.pow(F.lit(EXPONENTIAL_BASE), t / F.lit(float(s)))
    if kind == "step":
        return lr * F.pow(F.lit(float(s)), F.floor((t + 1) / F.lit(float(drop))))
    if kind == "time":
        return lr / (F.lit(1.0) + F.lit(float(s)) * t)
    if kind == "constant":
        return lr
    if kind == "shrinking":
        return lr + F.lit(SHRINK_SIZE) * F.pow(F.lit(SHRINK_BASE), t + 1)
    raise ValueError(f"unknown schedule {kind!r}")


def decay_per_n(kind: str, batch: Column, n: int, lr0: float = 0.1, s: float = 0.5, drop: float = 1.0) -> Column:
    """Rate at 1-based ``batch`` when the schedule moves only at batches n, 2n, ...;
    before the first move the rate is ``lr0``."""
    turn = F.floor(batch / F.lit(n)) - 1
    return F.when(batch < n, F.lit(float(lr0))).otherwise(decay(kind, turn, lr0, s, drop))
