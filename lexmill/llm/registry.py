"""Names, functions and SQL of this package's queries."""

from __future__ import annotations

from importlib import import_module

from lexmill.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ("corpus_queries", "search_queries", "audit_queries")


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for module in MODULES:
        import_module(f"lexmill.llm.{module}")


def queries() -> dict[str, Query]:
    load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    load()
    return dict(ORACLES)
