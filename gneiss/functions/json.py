"""JSON texts walked by a path that is a column, and laid out by lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions.arrays import let, running_sums

_TOKENS = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|[{}\[\],:]|[^\s{}\[\],:"]+'


def walk(json: Column, path: Column) -> Column:
    """What a path of keys parted by dots leads to: (value as JSON text, problem).

    A key of an object is a name, one of an array a place, counted from the end if it is negative. Problems: ``invalid JSON``, ``invalid path`` (no place of the array), ``cannot index`` (neither object nor array), ``not found`` (missing, or null). An empty or null path leads to the whole, even if that is null. Keys of objects come sorted; objects with a repeated key are no JSON here.
    """
    parsed = F.try_parse_json(json)
    keys = F.when(F.coalesce(F.length(path), F.lit(0)) > 0, F.split(path, r"\.", -1)).otherwise(F.array().cast("array<string>"))
    state = lambda value, problem: F.struct(value.alias("value"), problem.cast("string").alias("problem"))

    def step(acc: Column, key: Column) -> Column:
        v = acc["value"]
        kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
        items = F.try_variant_get(v, "$", "array<variant>")
        place = F.when(key.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(key).try_cast("int"))
        at = F.when(place < 0, place).otherwise(place + 1)
        inside = F.coalesce((at <= F.size(items)) & (-at <= F.size(items)), F.lit(False))
        return (
            F.when(acc["problem"].isNotNull(), acc)
            .when(F.startswith(kind, F.lit("OBJECT")), state(F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), key), F.lit(None)))
            .when(~F.startswith(kind, F.lit("ARRAY")), state(v, F.lit("cannot index")))
            .when(inside, state(F.try_element_at(items, at), F.lit(None)))
            .otherwise(state(v, F.lit("invalid path")))
        )

    end = F.aggregate(keys, state(parsed, F.when(parsed.isNull(), "invalid JSON")), step)

    def told(s: Column) -> Column:
        missing = (F.coalesce(F.schema_of_variant(s["value"]), F.lit("VOID")) == "VOID") & (F.size(keys) > 0)
        problem = F.coalesce(s["problem"], F.when(missing, "not found"))
        return F.struct(F.when(problem.isNull(), F.to_json(s["value"])).alias("value"), problem.alias("problem"))

    return let(end, told)


def pretty(json: Column) -> Column:
    """A JSON text with a line for each member and element, two spaces a level; keys in their order, values as they are written. Null if it is no JSON."""

    def layout(tokens: Column) -> Column:
        opens, closes = ("{", "["), ("}", "]")
        levels = running_sums(F.transform(tokens, lambda t: F.when(t.isin(*opens), 1).when(t.isin(*closes), -1).otherwise(0)))
        line = lambda n: F.concat(F.lit("\n"), F.repeat(F.lit("  "), n.cast("int")))
        rows = F.arrays_zip(tokens.alias("t"), F.concat(F.array(F.lit("")), tokens).alias("before"), F.concat(F.slice(tokens, F.lit(2), F.size(tokens)), F.array(F.lit(""))).alias("after"), levels.alias("level"))

        def piece(r: Column) -> Column:
            t = r["t"]
            return (
                F.when(t.isin(*opens), F.when(r["after"].isin(*closes), t).otherwise(F.concat(t, line(r["level"] + 1))))
                .when(t.isin(*closes), F.when(r["before"].isin(*opens), t).otherwise(F.concat(line(r["level"] - 1), t)))
                .when(t == ",", F.concat(t, line(r["level"])))
                .when(t == ":", F.lit(": "))
                .otherwise(t)
            )

        return F.array_join(F.transform(F.filter(rows, lambda r: r["t"].isNotNull()), piece), "")

    return F.when(F.try_parse_json(json).isNotNull(), let(F.regexp_extract_all(json, F.lit(_TOKENS), F.lit(0)), layout))
