"""A guarded, read-only SQL facade over a folder of tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> None:
    """Temporary views of the tables."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def select(spark: SparkSession, query: str, limit: int = 100) -> DataFrame:
    """Only a statement that begins with SELECT runs. Without the word LIMIT in it, at most ``limit`` (1 to 1000) rows return."""
    text = query.strip().rstrip(";")
    if not re.match(r"(?i)select\b", text):
        raise ValueError("only SELECT statements are allowed")
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    found = spark.sql(text)
    return found if "LIMIT" in text.upper() else found.limit(limit)


def display(df: DataFrame, cells: int = 50) -> DataFrame:
    """All cells as text of at most ``cells`` characters."""
    return df.select(*(F.left(F.col(c).cast("string"), F.lit(cells)).alias(c) for c in df.columns))
