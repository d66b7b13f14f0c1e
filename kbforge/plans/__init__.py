"""Queries over the standard tables, one for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that each hold QUERIES and ORACLES.
MODULES: tuple[str, ...] = ("analytics", "cases", "catalog", "corpus", "files", "graph", "retrieval", "streams")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__name__}.{name}"), attribute)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["eval_retrieval"](spark, sf_dir)
