"""Columns of an input that an operator does not use: kept clear of its own names."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, functions as F


def neutral_names(columns: list[str], used: tuple[str, ...]) -> list[str]:
    return [c if c in used else f"other{i}" for i, c in enumerate(columns)]


def passing_through(*used: str) -> Callable:
    """Let an operator ``fn(docs, ...)`` see the columns it does not use under neutral names,
    so that none clashes with one of its own, and give them back as they were. A column
    that the operator adds takes the place of an input column of the same name."""

    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(fn)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            names = neutral_names(docs.columns, used)
            out = fn(docs.toDF(*names), *args, **options)
            added = [c for c in out.columns if c not in names]
            kept = [F.col(n).alias(c) for n, c in zip(names, docs.columns) if c not in added]
            return out.select(*kept, *added)

        return run

    return wrap
