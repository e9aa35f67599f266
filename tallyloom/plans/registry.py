"""Collects the named queries and their checking SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.sources.corpora import spread

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_AREAS = (
    "corpus", "packing", "chat", "preference", "scoring", "answers", "instructions",
    "losses", "rollups", "runlogs", "vocab", "incremental", "selection",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over the cores when they come in too few splits."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def _load() -> None:
    for area in _AREAS:
        importlib.import_module(f"tallyloom.plans.{area}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
