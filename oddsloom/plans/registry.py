"""All registered queries of the analytics library and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("scalars", "quote_core", "labels", "entities", "quality", "pricing", "ratings", "evaluation", "exchange", "ingest", "modelling")


def _plans() -> list:
    return [import_module(f"oddsloom.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _plans():
        out |= m.PLANS.queries
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _plans():
        out |= m.PLANS.oracles
    return out


class Plans:
    """Collects the queries of one module: ``@PLANS.add(sql)`` above a function (spark, sf_dir) -> DataFrame."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict = {}

    def add(self, sql: str | None = None):
        from oddsloom.sources.bind import with_views

        def put(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = with_views(sql)
            return f

        return put
