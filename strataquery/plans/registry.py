"""All registered queries of the engine with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
MODULES = ("text_scope", "retrieval", "relational", "graph_versions", "memory", "lifecycle", "answers", "decisions", "streams")


def query(name: str, oracle: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function, with DuckDB SQL for the same rows where SQL expresses it."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"strataquery.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
