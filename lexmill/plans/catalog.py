"""All registered queries and their checking SQL."""

from __future__ import annotations

from importlib import import_module

from lexmill.plans.registry import ORACLES, QUERIES, Query

AREAS = ("flagship", "scans", "profiling", "texts", "features", "evaluation", "models", "shaping", "logs", "serving")


def _load() -> None:
    for area in AREAS:
        import_module(f"lexmill.plans.{area}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
