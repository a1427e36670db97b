"""JSON paths, layouts and delimited texts against Python's own modules."""

import csv
import io
import json
import random

from pyspark.sql import functions as F

from gneiss.functions import delimited
from gneiss.functions import json as J


def walked(text, path):
    """A path by a plain loop."""
    try:
        at = json.loads(text)
    except ValueError:
        return None, "invalid JSON"
    for key in path.split(".") if path else []:
        if isinstance(at, dict):
            at = at.get(key)
        elif isinstance(at, list):
            try:
                at = at[int(key)]
            except (ValueError, IndexError):
                return None, "invalid path"
        else:
            return None, "cannot index"
    return (None, "not found") if at is None and path else (at, None)


def nested(pick, depth=3):
    kind = pick.randrange(7 if depth else 4)
    if kind < 4:
        return (pick.randrange(99), "x.y'\"é\n\\" [: pick.randrange(8)], None, True)[kind]
    if kind == 4:
        return [nested(pick, depth - 1) for _ in range(pick.randrange(4))]
    return {k: nested(pick, depth - 1) for k in pick.sample(["b", "a", "0", "c d", "q'", 'r"', "?", ""], pick.randrange(5))}


def test_walk_equals_a_loop(spark):
    pick = random.Random(2)
    keys = ["a", "b", "0", "1", "-1", "-3", "c d", "q'", 'r"', "?", "", "x", "+1"]
    rows = [(i, pick.choice(["{", "", "[1", "nul"]) if pick.random() < 0.05 else json.dumps(nested(pick, 4)), ".".join(pick.choices(keys, k=pick.randrange(4)))) for i in range(1500)]
    got = {r.i: r.w for r in spark.createDataFrame([*rows, (-1, None, "a"), (-2, '{"a": [1]}', None)], "i int, t string, p string").select("i", J.walk(F.col("t"), F.col("p")).alias("w")).collect()}
    assert (got.pop(-1).problem, json.loads(got.pop(-2).value)) == ("invalid JSON", {"a": [1]})
    problems = set()
    for i, t, p in rows:
        value, problem = walked(t, p)
        assert got[i].problem == problem, (t, p)
        assert problem or json.loads(got[i].value) == value, (t, p)
        problems.add(problem)
    assert len(problems) == 5


def test_pretty_equals_dumps(spark):
    pick = random.Random(4)
    rows = [(i, nested(pick, 4)) for i in range(400)] + [(400, list(range(900)))]
    texts = [(i, json.dumps(v, ensure_ascii=False, separators=pick.choice([(",", ":"), (" ,\n", " : ")]))) for i, v in rows]
    got = {r.i: r.p for r in spark.createDataFrame([*texts, (-1, "{"), (-2, None)], "i int, t string").select("i", J.pretty(F.col("t")).alias("p")).collect()}
    assert got.pop(-1) is None and got.pop(-2) is None
    assert got == {i: json.dumps(v, indent=2, ensure_ascii=False) for i, v in rows}


def test_delimited_equals_csv(spark):
    pick = random.Random(6)
    rows = [(i, "".join(pick.choices('a"",;\t\n é|.', k=pick.randrange(25))), pick.choice(",;\t|.t")) for i in range(1500)]
    rows += [(1500, "a,b\r\nc,\r\n", ","), (1501, "x," * 20000 + "y", ","), (1502, '"' + 'q""\n' * 20000 + '",z', ",")]
    df = spark.createDataFrame([*rows, (-1, None, ",")], "i int, t string, d string").select("i", delimited.rows_of(F.col("t"), F.col("d")).alias("r"))
    df = df.select("i", "r", delimited.records_of(F.col("r")).alias("m"))
    got = {r.i: r for r in df.collect()}
    assert got.pop(-1).r is None
    for i, t, d in rows:
        expected = list(csv.reader(io.StringIO(t), delimiter=d))
        assert got[i].r == expected, (t, d)
        assert got[i].m == [dict(zip(expected[0], r)) for r in expected[1:]], (t, d)


def test_json_to_delimited_and_back(spark):
    pick = random.Random(8)
    value = lambda: "".join(pick.choices('ab",;\n\ré ', k=pick.randrange(5)))
    objects = [[{k: value() for k in pick.sample(["z", "a", "k k"], 3 if n == 0 else pick.randrange(4))} for n in range(pick.randrange(1, 5))] for _ in range(200)]
    lists = [[[value() for _ in range(pick.randrange(1, 4))] for _ in range(pick.randrange(1, 4))] for _ in range(200)]
    rows = [(i, json.dumps(v), pick.choice(",;")) for i, v in enumerate(objects + lists)]
    odd = [(-1, '[{"a": 1}, {"b": 2}]', ","), (-2, "[]", ","), (-3, '{"a": 1}', ","), (-4, "[", ","), (-5, None, ","), (-6, "[[1, null, true, [2]], [3.5]]", ","), (-7, "[[1], 2]", ",")]
    got = {r.i: r.x for r in spark.createDataFrame(rows + odd, "i int, t string, d string").select("i", delimited.text_of(F.col("t"), F.col("d")).alias("x")).collect()}
    assert [tuple(got[-k]) for k in range(1, 8)] == [(None, "unknown key"), ("", None), (None, "no array"), (None, "no array"), (None, "no array"), ("1,,true,[2]\r\n3.5\r\n", None), (None, "no row")]
    for (i, _, d), v in zip(rows, objects + lists):
        out = io.StringIO()
        if isinstance(v[0], dict):
            w = csv.DictWriter(out, fieldnames=list(v[0]), delimiter=d)
            w.writeheader()
            w.writerows(v)
        else:
            csv.writer(out, delimiter=d).writerows(v)
        assert got[i].text == out.getvalue(), v
