"""Delimited texts, a whole file in a value, with delimiter and header by row; and JSON arrays as such texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions.arrays import let


def rows_of(text: Column, delimiter: Column) -> Column:
    """The rows of a text as arrays of fields, with quotes taken off; ragged ones as they are, a blank line as an empty one.

    A quote opens a field only at its start; within it, two quotes are one, and delimiters and line ends are text. What follows the closing quote belongs to the field, and a quote that never closes runs to the end. Lines end with \\n, \\r\\n or \\r. The delimiter is one character. Fields are found one after another by a pattern that keeps no stack, then cut into rows, so neither long fields nor wide rows matter. Null texts have null, empty ones no rows.
    """
    d = F.concat(F.lit(r"\x{"), F.hex(F.ascii(delimiter)), F.lit("}"))
    field = F.concat(F.lit(r'("[^"]*+(?:""[^"]*+)*+(?:"[^'), d, F.lit(r'\r\n]*+|\z)|[^"'), d, F.lit(r"\r\n][^"), d, F.lit(r"\r\n]*+|)("), d, F.lit(r"|\r\n|\n|\r|\z)"))
    part = lambda k: F.regexp_extract_all(text, field, F.lit(k))

    def plain(raw: Column) -> Column:
        quoted = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*)$'
        inner = F.replace(F.regexp_extract(raw, quoted, 1), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(raw, F.lit('"')), F.concat(inner, F.regexp_extract(raw, quoted, 2))).otherwise(raw)

    def cut(v: Column) -> Column:
        raws, ends = v["raws"], v["ends"]
        n = F.size(raws)
        # The pattern also matches nothing at the very end, which is a field only after a delimiter.
        extra = (F.get(raws, n - 1) == "") & (F.get(ends, n - 1) == "") & ~F.coalesce(F.get(ends, n - 2) == v["d"], F.lit(False))
        last = F.when(extra, n - 1).otherwise(n)
        stops = F.array_compact(F.transform(ends, lambda e, i: F.when((e != v["d"]) & (i < last), i + 1)))
        starts = F.concat(F.array(F.lit(0)), stops)
        row = lambda a, b: F.slice(raws, a + 1, b - a)
        rows = F.zip_with(F.slice(starts, F.lit(1), F.size(stops)), stops, row)
        return F.transform(rows, lambda r: F.when((F.size(r) == 1) & (F.get(r, 0) == ""), F.array().cast("array<string>")).otherwise(F.transform(r, plain)))

    return F.when(text.isNotNull(), let(F.struct(part(1).alias("raws"), part(2).alias("ends"), delimiter.alias("d")), cut))


def records_of(rows: Column) -> Column:
    """Rows after the first as maps by the first: of repeated names the last that the row reaches counts; names that a short row doesn't reach are missing, fields beyond the names are left out."""

    def by_name(rows: Column) -> Column:
        names = F.get(rows, 0)

        def record(row: Column) -> Column:
            pairs = F.slice(F.zip_with(names, row, lambda k, v: F.struct(k.alias("k"), v.alias("v"))), F.lit(1), F.least(F.size(names), F.size(row)))
            keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
            return F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(F.filter(pairs, lambda p: p["k"] == k), F.lit(-1))["v"]))

        return F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), record)

    return let(rows, lambda r: F.when(F.size(r) > 0, by_name(r)).otherwise(F.array().cast("array<map<string,string>>")))


def text_of(json: Column, delimiter: Column) -> Column:
    """A JSON array of objects or of arrays as a delimited text: (text, problem).

    Objects come as a row of the first one's keys, in their order, and a row each; a key that one lacks is empty, and one that the first lacks a problem. Fields are quoted where they must be; lines end with \\r\\n. Values are written as the JSON has them, strings without their quotes, null as nothing. An empty array is an empty text; no array is a problem.
    """
    items = F.from_json(json, F.lit("array<string>"))
    is_array = F.startswith(F.ltrim(json), F.lit("[")) & F.try_parse_json(json).isNotNull()

    def line(fields: Column, d: Column) -> Column:
        def quoted(x: Column) -> Column:
            must = F.contains(x, d) | x.rlike('["\r\n]') | ((x == "") & (F.size(fields) == 1))
            return F.when(must, F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

        return F.concat(F.call_function("array_join", F.transform(fields, lambda x: quoted(F.coalesce(x, F.lit("")))), d), F.lit("\r\n"))

    def build(v: Column) -> Column:
        items, d, keys = v["items"], v["d"], v["keys"]
        maps = F.transform(items, lambda e: F.when(F.startswith(F.ltrim(e), F.lit("{")), F.from_json(e, F.lit("map<string,string>"))))
        lists = F.transform(items, lambda e: F.when(F.startswith(F.ltrim(e), F.lit("[")), F.from_json(e, F.lit("array<string>"))))
        odd = lambda m: m.isNull() | (F.size(F.array_except(F.map_keys(m), keys)) > 0)
        from_maps = let(maps, lambda ms: F.when(F.exists(ms, odd), F.struct(F.lit(None).cast("string").alias("text"), F.lit("unknown key").alias("problem"))).otherwise(F.struct(F.array_join(F.concat(F.array(line(keys, d)), F.transform(ms, lambda m: line(F.transform(keys, lambda k: F.try_element_at(m, k)), d))), "").alias("text"), F.lit(None).cast("string").alias("problem"))))
        from_lists = let(lists, lambda ls: F.when(F.exists(ls, lambda x: x.isNull()), F.struct(F.lit(None).cast("string").alias("text"), F.lit("no row").alias("problem"))).otherwise(F.struct(F.array_join(F.transform(ls, lambda x: line(x, d)), "").alias("text"), F.lit(None).cast("string").alias("problem"))))
        return F.when(keys.isNotNull(), from_maps).otherwise(from_lists)

    first = F.get(items, 0)
    bound = F.struct(items.alias("items"), delimiter.alias("d"), F.when(F.startswith(F.ltrim(first), F.lit("{")), F.json_object_keys(first)).alias("keys"))
    empty = F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("problem"))
    return F.when(~F.coalesce(is_array, F.lit(False)), F.struct(F.lit(None).cast("string").alias("text"), F.lit("no array").alias("problem"))).when(F.size(items) == 0, empty).otherwise(let(bound, build))
