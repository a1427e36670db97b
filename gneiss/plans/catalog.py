"""Every query of the library outside the optional subpackages, with its SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from gneiss.plans import base

MODULES = ("text_queries", "search_queries", "conversation_queries", "metric_queries", "rule_queries", "graph_queries", "sql_queries", "source_queries", "python_queries", "stream_queries", "state_queries")


def _all() -> None:
    for m in MODULES:
        importlib.import_module(f"gneiss.plans.{m}")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: ranked retrieval."""
    return queries()["memory_search"](spark, sf_dir)


def queries() -> dict[str, base.Query]:
    _all()
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(base.ORACLE)
