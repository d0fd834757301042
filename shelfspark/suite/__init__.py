"""Runnable queries over the given tables, each with its SQL check where SQL can say it."""

from importlib import import_module

MODULES = ["scalars", "tables", "search", "jobs"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"shelfspark.suite.{name}")
