"""Patterns and edits against Python's own, over random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gneiss.functions import edits, regex
from gneiss.functions.arrays import running_sums


def test_running_sums(spark):
    pick = random.Random(1)
    rows = [[pick.randrange(9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1000)]
    got = [r.s for r in spark.createDataFrame(list(enumerate(rows)), "i int, x array<int>").select("i", running_sums(F.col("x")).alias("s")).orderBy("i").collect()]
    assert got == [[sum(x[:k]) for k in range(len(x))] for x in rows]


PATTERNS = [
    ("a*", ""), (r"\b", ""), (r"(\w+)\s(\w+)", ""), (r"(?P<first_one>a)(b)?", "i"), (r"^\w", "m"), (r"^.+$", "m"), (r"a.b", "s"), (r"a.b", ""), (r"(?P<x>[ab])(?P=x)", ""),
    (r"[[(&&]", ""), (r"[]a]+", ""), (r"[^]\n]+", ""), (r"\Z", ""), (r"é|ß", "i"), (r"\d+", ""), (r"(?<=a)b|$", ""), (r"(a|(b))+", ""), (r"x{0,2}", ""),
]


@pytest.mark.parametrize(("pattern", "flags"), PATTERNS)
def test_matches_equal_finditer(spark, pattern, flags):
    pick = random.Random(3)
    texts = ["", "\n", "a" * 700] + ["".join(pick.choice("aabbABéÉß 12[](&\n\r😀x") for _ in range(pick.randrange(30))) for _ in range(150)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string").select("i", regex.all_matches(F.col("t"), pattern, flags).alias("m"))
    got = {r.i: r.m for r in df.collect()}
    bits = sum({"i": re.I, "m": re.M, "s": re.S}[c] for c in flags)
    assert got.pop(-1) is None
    for i, t in enumerate(texts):
        expected = [(m[0], *m.span(), [g or "" for g in m.groups()], {k: v or "" for k, v in m.groupdict().items()}) for m in re.finditer(pattern, t, bits)]
        assert [tuple(x) for x in got[i]] == expected, t


def test_a_wrong_pattern_raises():
    with pytest.raises(re.error):
        regex.all_matches(F.lit("x"), "(")


def edited(text, todo, unique):
    """Edits by a plain loop."""
    new, lines = text, []
    for k, (old, put, every) in enumerate(todo):
        at = [i for i in range(len(new)) if old and new.startswith(old, i)]
        if not at:
            return text, k, k + 1, "not found", []
        if unique and not every and len(at) > 1:
            return text, k, k + 1, "ambiguous", [new[:i].count("\n") + 1 for i in at]
        new = new.replace(old, put) if every else new.replace(old, put, 1)
    return new, len(todo), None, None, lines


@pytest.mark.parametrize("unique", [True, False])
def test_edits_equal_a_loop(spark, unique):
    pick = random.Random(7)
    word = lambda n: "".join(pick.choice("ab\n\\E$é") for _ in range(pick.randrange(n)))
    rows = [(i, word(14), [(word(4), word(4), pick.random() < 0.4) for _ in range(pick.randrange(4))]) for i in range(600)]
    df = spark.createDataFrame([*rows, (-1, None, [("a", "b", False)])], f"i int, t string, e array<{edits.EDIT}>")
    got = {r.i: r.r for r in df.select("i", edits.apply_edits(F.col("t"), F.col("e"), unique).alias("r")).collect()}
    assert got.pop(-1) is None
    assert {i: tuple(r) for i, r in got.items()} == {i: edited(t, e, unique) for i, t, e in rows}
    assert len({r.problem for r in got.values()}) == 2 + unique


def test_loose_edits(spark):
    text = "def f():  \n\tx = 1\n\n    y = 2\t \nend\nend "
    cases = [("def f():\n    x = 1", "NEW", "NEW\n\n    y = 2\t \nend\nend "), ("end\nend\n", None, "not found"), ("y = 2", "z", text.replace("y = 2", "z")), ("    y = 2\nend", "q", "def f():  \n\tx = 1\n\nq\nend "), ("end  ", None, "ambiguous"), ("", None, "not found")]
    df = spark.createDataFrame([(i, text, [(s, r or "", False)]) for i, (s, r, _) in enumerate(cases)], f"i int, t string, e array<{edits.EDIT}>")
    got = [r.r for r in df.select("i", edits.apply_edits(F.col("t"), F.col("e"), loose=True).alias("r")).orderBy("i").collect()]
    assert [r.problem or r.text for r in got] == [c[2] for c in cases]
    assert got[4].lines == [5, 6] and got[4].text == text


def test_a_place_at_the_start_that_overlaps_the_next_counts(spark):
    cases = [("aba\nababa is", "aba\naba"), ("Ea Ea Ea Ea Ea is", "Ea Ea Ea Ea "), ("aaa", "aa"), ("a\na\na\nb", "a\na\n")]
    df = spark.createDataFrame([(i, t, [(s, "x", False)]) for i, (t, s) in enumerate(cases)], f"i int, t string, e array<{edits.EDIT}>")
    got = [tuple(r.r) for r in df.select(edits.apply_edits(F.col("t"), F.col("e")).alias("r")).orderBy("i").collect()]
    assert got == [edited(t, [(s, "x", False)], True) for t, s in cases]
    assert [g[3] for g in got] == [None, "ambiguous", "ambiguous", "ambiguous"] and got[3][4] == [1, 2]
