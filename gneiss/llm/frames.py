"""Rows that a Python predicate over texts keeps, whatever the names and types of their other columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.session import ship


def positional(docs: DataFrame) -> DataFrame:
    """``docs`` with columns c0, c1, ...: names with dots, repeats or spaces do no harm from here on."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def kept(docs: DataFrame, text_col: str, good: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` for whose texts ``good`` is true, with the columns of ``docs``; no shuffle.

    A text goes to Python once, and what is left out doesn't come back. ``good`` gets a batch's texts, null
    ones included, and returns a boolean each. Repeated rows stay repeated; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = positional(docs)
    text = f"c{docs.columns.index(text_col)}"
    schema = rows.schema
    if schema[text].dataType.simpleString() != "string":
        rows, text = rows.withColumn("text", F.col(text).cast("string")), "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(good(b.column(text)))).select(schema.names)

    return rows.mapInArrow(run, schema).toDF(*docs.columns)
