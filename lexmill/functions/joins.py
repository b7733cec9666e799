"""Join helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = same if cond is None else cond & same
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def hinted(df: DataFrame, max_rows: int | None, limit: int = 100_000) -> DataFrame:
    """Broadcast hint for a frame whose row count is proven to be at most
    ``max_rows``; without a proof the choice stays with Spark's statistics."""
    return F.broadcast(df) if max_rows is not None and max_rows <= limit else df
