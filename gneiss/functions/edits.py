"""Exact edits of texts, one after another, as a fold over an array of edits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions.arrays import let, running_sums

EDIT = "struct<search:string,replace:string,all:boolean>"


def match_lines(text: Column, search: Column) -> Column:
    """The line, from 1, of every place where ``search`` begins, overlapping ones too; empty for an empty search."""
    here = F.concat(F.lit(r"(?=\Q"), F.replace(search, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    pieces = F.when(F.length(search) > 0, F.split(text, here, -1)).otherwise(F.array().cast("array<string>"))

    def lines(p: Column) -> Column:
        at = F.transform(running_sums(F.transform(p, lambda x: (F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))).cast("long"))), lambda n: n + 1)
        # The whole text is asked: where places overlap, the first piece is shorter than the search.
        return F.when(F.startswith(text, search), at).otherwise(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))))

    return F.when(F.length(search) > 0, let(pieces, lines)).otherwise(F.array().cast("array<bigint>"))


def _plain(line: Column) -> Column:
    return F.replace(F.regexp_replace(line, r"(?U)[\s\x1c-\x1f]+$", ""), F.lit("\t"), F.lit("    "))


def loose_lines(text: Column, search: Column) -> Column:
    """The line, from 1, of every run of lines equal to those of ``search`` but for tabs and trailing white space."""
    plain = lambda t: F.concat(F.lit("\n"), F.array_join(F.transform(F.split(t, "\n", -1), _plain), "\n"), F.lit("\n"))
    # Every line begins after a line end here, so a run that begins at line k has k of them before its second character.
    return match_lines(plain(text), plain(search))


def apply_edits(text: Column, edits: Column, unique: bool = True, loose: bool = False) -> Column:
    """The text after edits (search, replace, all), in order: (text, applied, failed, problem, lines).

    An edit that isn't ``all`` replaces the only place where its search is; with ``unique`` off, the first of several. The first edit that can't be applied stops the rest: ``failed`` is its number from 1, ``problem`` ``not found`` or ``ambiguous``, ``lines`` where an ambiguous one was seen, and ``text`` is the original, as nothing is to be written then. With ``loose``, an edit that is found nowhere may replace the one run of lines that is the same but for tabs and trailing white space. Line ends of edits become \\n; an empty or null search is not found; places of ``all`` don't overlap. A null text has null.
    """
    nothing = F.array().cast("array<bigint>")
    state = F.struct(text.alias("text"), F.lit(0).alias("applied"), F.lit(None).cast("string").alias("problem"), nothing.alias("lines"))
    unix = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("\r\n"), F.lit("\n"))

    def put(acc: Column, new: Column) -> Column:
        return F.struct(new.alias("text"), (acc["applied"] + 1).alias("applied"), F.lit(None).cast("string").alias("problem"), nothing.alias("lines"))

    def stop(acc: Column, problem: str, lines: Column) -> Column:
        return F.struct(acc["text"].alias("text"), acc["applied"].alias("applied"), F.lit(problem).alias("problem"), lines.alias("lines"))

    def one(acc: Column, old: Column, new: Column, every: Column) -> Column:
        t = acc["text"]
        at = F.when(F.length(old) > 0, F.position(old, t)).otherwise(0)
        first = F.concat(F.left(t, at - 1), new, F.substring(t, at + F.length(old), F.lit(1 << 30)))
        lines = match_lines(t, old)
        several = F.when(F.size(lines) > 1, stop(acc, "ambiguous", lines)) if unique else F.when(F.lit(False), acc)
        missing = stop(acc, "not found", nothing)
        if loose:
            def run(k: Column) -> Column:
                rows = F.split(t, "\n", -1)
                n = F.size(F.split(old, "\n", -1))
                line = k[0].cast("int")
                return put(acc, F.array_join(F.concat(F.slice(rows, F.lit(1), line - 1), F.array(new), F.slice(rows, line + n, F.size(rows))), "\n"))

            missing = F.when(F.length(old) == 0, missing).otherwise(let(loose_lines(t, old), lambda k: F.when(F.size(k) == 0, missing).when(F.size(k) > 1, stop(acc, "ambiguous", k)).otherwise(run(k))))
        return F.when(at == 0, missing).when(every, put(acc, F.replace(t, old, new))).otherwise(F.coalesce(several, put(acc, first)))

    def step(acc: Column, e: Column) -> Column:
        return F.when(acc["problem"].isNotNull(), acc).otherwise(one(acc, unix(e["search"]), unix(e["replace"]), F.coalesce(e["all"], F.lit(False))))

    done = F.aggregate(F.coalesce(edits, F.array().cast(f"array<{EDIT}>")).cast(f"array<{EDIT}>"), state, step)
    out = let(done, lambda d: F.struct(F.when(d["problem"].isNull(), d["text"]).otherwise(text).alias("text"), d["applied"].alias("applied"), F.when(d["problem"].isNotNull(), d["applied"] + 1).alias("failed"), d["problem"].alias("problem"), d["lines"].alias("lines")))
    return F.when(text.isNotNull(), out)
