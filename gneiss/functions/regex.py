"""Regular expressions written for Python, run by Spark's built-ins: all matches of a text with spans and groups."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions.arrays import let, running_sums

_CLASS = re.compile(r"\\[\s\S]|\[|&&")
_TOKEN = re.compile(r"(\\Z)|(\\[\s\S])|(\[\^?\]?(?:\\[\s\S]|[^\]\\])*\])|\(\?P<\w+>|\(\?P=(\w+)\)")


def java_pattern(pattern: str, flags: str = "") -> tuple[str, re.Pattern[str]]:
    """A Python pattern in Java's syntax, and compiled by Python, which raises ``re.error`` where it is wrong. Flags are any of i, m and s.

    Named groups become numbered ones, classes and line ends mean what they mean in Python. White space is Unicode's, without the four separators \\x1c to \\x1f.
    """
    bits = 0
    for c, bit in (("i", re.I), ("m", re.M), ("s", re.S)):
        bits |= bit if c in flags else 0
    compiled = re.compile(pattern, bits)

    def translate(m: re.Match[str]) -> str:
        if m[1]:
            return r"\z"
        if m[2]:
            return m[2]
        if m[3]:
            head = re.match(r"\[\^?\]?", m[3])[0]
            first = head.replace("]", r"\]")
            return first + _CLASS.sub(lambda x: x[0] if x[0][0] == "\\" else "".join("\\" + c for c in x[0]), m[3][len(head) : -1]) + "]"
        return f"(?:\\{compiled.groupindex[m[4]]})" if m[4] else "("

    return f"(?dU{''.join(c for c in 'ims' if c in flags)})(?:{_TOKEN.sub(translate, pattern)})", compiled


def all_matches(text: Column, pattern: str, flags: str = "") -> Column:
    """The matches of a text in order: an array of (match, start, stop, groups, named), offsets in characters.

    Offsets are running sums over the lengths of matches and of the gaps between them, so the pattern runs twice and once more for each group, and nothing is shuffled. A group that took no part is empty, as Spark has it. A null text has null, a text without a match an empty array.
    """
    java, compiled = java_pattern(pattern, flags)
    # In texts with characters beyond 16 bits, matches could begin between the two halves of one.
    whole = r"(?:\A|(?<=[\x{0}-\x{10FFFF}]))" + java
    java = F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), whole).otherwise(java)
    names = sorted(compiled.groupindex, key=compiled.groupindex.get)
    group = lambda k: F.regexp_extract_all(text, java, F.lit(k))
    zero = F.array(F.lit(0).cast("long"))

    def spans(found: Column, gaps: Column) -> Column:
        # Java's split has no gap before an empty match at the very start.
        sized = F.when(F.size(gaps) == F.size(found), F.concat(zero, gaps)).otherwise(gaps)
        before = F.concat(zero, F.transform(found, lambda x: F.length(x).cast("long")))
        starts = running_sums(F.concat(F.zip_with(sized, before, lambda a, b: a + b), zero))
        # The sum before element i + 1 is where match i starts.
        return F.zip_with(found, F.slice(starts, F.lit(2), F.size(found)), lambda x, at: F.struct(x.alias("match"), at.alias("start"), (at + F.length(x)).alias("stop")))

    gaps = F.transform(F.split(text, java, -1), lambda x: F.length(x).cast("long"))
    rows = let(F.struct(group(0).alias("found"), gaps.alias("gaps")), lambda v: spans(v["found"], v["gaps"]))
    if compiled.groups:
        zipped = F.arrays_zip(*[group(k + 1).alias(f"g{k}") for k in range(compiled.groups)])
        groups = F.transform(zipped, lambda z: F.array(*[z[f"g{k}"] for k in range(compiled.groups)]))
    else:
        groups = F.transform(group(0), lambda _: F.array().cast("array<string>"))
    named = lambda g: F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.get(g, compiled.groupindex[n] - 1) for n in names])) if names else F.create_map().cast("map<string,string>")
    both = F.zip_with(rows, groups, lambda r, g: F.struct(r["match"].alias("match"), r["start"].alias("start"), r["stop"].alias("stop"), g.alias("groups"), named(g).alias("named")))
    return F.when(text.isNotNull(), both)
