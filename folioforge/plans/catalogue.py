"""Named queries over the test tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import connectors, graph, knowledge, merging, scalars, search

_PARTS = (scalars, merging, graph, search, connectors, knowledge)


def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.rank_candidates(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
