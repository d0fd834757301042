"""Queries of this subpackage by name, with their SQL checks."""

from __future__ import annotations

from importlib import import_module

from shelfspark.suite.registry import Query

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

MODULES = ["queries"]


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def load_all() -> None:
    for name in MODULES:
        import_module(f"shelfspark.llm.{name}")
