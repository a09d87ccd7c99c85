"""Registered queries and their DuckDB oracles, by operator name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

PLANS = ("values", "accounts", "joins", "book", "signals", "metrics", "research", "storage")
_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers ``f(spark, sf_dir) -> DataFrame`` and, where SQL can express it, its oracle."""

    def add(f: Callable) -> Callable:
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    for name in PLANS:
        import_module(f"pmspark.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
