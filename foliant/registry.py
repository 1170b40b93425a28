"""All queries of the library and their SQL. A module adds its own with the decorator query()."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
MODULES = ("plans.dashboard", "plans.monitoring", "plans.jobs", "plans.scalars", "plans.windows", "plans.sets", "plans.retrieval", "plans.layout", "plans.quality", "plans.tables", "plans.streams", "plans.files", "plans.stores", "plans.pages", "plans.office", "plans.extras", "plans.cleaning", "plans.service")


def query(sql: str | None = None, name: str | None = None):
    """Register f(spark, sf_dir) under its name; sql says the same for the oracle."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"foliant.{module}")
