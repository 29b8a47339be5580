"""Registered queries: one per operator, with the matching plain SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgloom.catalog.fixtures import Fixture

_REGISTRY: dict[str, tuple[Callable[[Fixture], DataFrame], str | None]] = {}
_MODULES = (
    "terms", "retrieval", "relations", "entities", "memory", "evaluate", "cost",
    "responses", "sources", "chains", "prompts", "methods",
)


def query(name: str, sql: str | None = None):
    """Register ``fn(fixture) -> DataFrame`` under ``name``."""

    def add(fn):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = (fn, sql)
        return fn

    return add


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"kgloom.catalog.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, sf_dir: fn(Fixture.of(spark, sf_dir))

    return {name: bind(fn) for name, (fn, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql}
