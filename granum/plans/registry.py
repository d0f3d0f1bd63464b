"""Collects the named queries: each is a DataFrame plan with, where possible, oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of this package that register queries.
MODULES: tuple[str, ...] = ("taxi", "retail", "profile", "stats", "textual", "retrieval")

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a plan under ``name``; ``sql`` is its oracle, None for row-only checks."""

    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"granum.plans.{m}")


def queries() -> dict[str, Query]:
    """All named queries."""
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    """Oracle SQL by query name."""
    _load()
    return dict(_ORACLES)
