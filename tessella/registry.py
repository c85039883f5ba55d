"""Registry of the engine's own queries: name -> (Spark function, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("retrieval", "evaluation", "layout", "catalog", "feedback", "verification", "reading")
_found: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL if there is one."""

    def put(f: Query) -> Query:
        _found[f.__name__] = (f, sql)
        return f

    return put


def _load() -> dict[str, tuple[Query, str | None]]:
    for name in MODULES:
        import_module(f"tessella.plans.{name}")
    return _found


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _load().items() if sql is not None}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["d5_retrieve_topk"](spark, sf_dir)
