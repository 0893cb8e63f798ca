"""The table of queries: each names an operator, applies it to a view of the given tables, and has its SQL where there is one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SECTIONS = ("vectors", "observed", "intervals", "scenes", "graphs", "maintenance", "planning", "measurement", "grading", "sourced", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for s in SECTIONS:
        importlib.import_module(f"tessera.plans.{s}")
    return QUERIES, ORACLES
