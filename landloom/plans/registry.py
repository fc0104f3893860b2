"""All queries of the library with their SQL oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("grid", "shape", "panel", "text", "roads", "polygons", "statistics", "models")

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def register(f: Query) -> Query:
        _queries[name or f.__name__] = f
        if sql:
            _oracles[name or f.__name__] = sql
        return f

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"landloom.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["transition_topk"](spark, sf_dir)
