"""The registry of queries: a name, a function (spark, sf_dir) -> DataFrame, and DuckDB SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks that the rows of a small file with much work a row are dealt to.
TASKS = 256


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over TASKS tasks: Spark cuts a file by its bytes, so that few bytes are one task whatever work they bring. Below 2,000 rows that doesn't pay."""
    return rows.repartition(TASKS) if rows.count() > 2_000 else rows


def hits(column: str, words: tuple[str, ...] | list[str]) -> str:
    """SQL (Spark's and DuckDB's): how many of the words a lower-case text contains."""
    return "(" + " + ".join(f"CAST(contains({column}, '{w.replace(chr(39), chr(39) * 2)}') AS INT)" for w in words) + ")"


def any_hit(column: str, words: tuple[str, ...] | list[str]) -> str:
    """SQL: whether a lower-case text contains one of the words."""
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def first_best(scores: dict[str, str], default: str) -> str:
    """SQL: the name with the largest positive score; of equals, the first."""
    top = f"greatest({', '.join(scores.values())})"
    return f"CASE WHEN {top} <= 0 THEN '{default}' " + " ".join(f"WHEN {s} = {top} THEN '{n}'" for n, s in scores.items()) + " END"
