"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relata.plans.views import Source, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a function of a source as the query ``name``."""

    def register(build: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, folder: build((spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return build

    return register
