"""Helpers for expressions over arrays that are evaluated once and in linear or near-linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it; an expression that a lambda names is computed again for every element."""
    return F.get(F.transform(F.array(value), f), 0)


def running_sums(values: Column) -> Column:
    """For each element the sum of those before it. Elements go in runs of 256, since a fold copies its array at every step."""
    none = F.array().cast("array<bigint>")

    def scan(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), none.alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")))["out"]

    def runs(xs: Column) -> Column:
        n = F.size(xs)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 256).cast("int")), lambda k: F.slice(xs, k * 256 + 1, F.lit(256)))).otherwise(F.array().cast("array<array<bigint>>"))

    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    return let(values.cast("array<bigint>"), lambda v: let(runs(v), lambda r: F.flatten(F.zip_with(r, scan(F.transform(r, total)), lambda xs, base: F.transform(scan(xs), lambda s: s + base)))))
