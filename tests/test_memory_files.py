"""Memory files and profiles: varied and malformed texts, written as files and read again."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gneiss.sources import memory_files as M
from gneiss.sources import named_files, profiles

MD = "# User Memory\n\n*Last updated: x*\n- first\n##\n## \n- `a  b` cut `c` here\n  ## Two Words \r\n - spaced   \n-none\n text\n* note\n-  two ` open\n### deep\n- x \n## ÉTÉ\n- ``\n- `t`"


def test_markdown_entries(spark):
    df = spark.createDataFrame([(MD,), (None,), ("",), ("- a",)], "t string").select(M.markdown_entries(F.col("t"), F.lit("user")).alias("e"))
    rows = [[tuple(e) for e in r.e] for r in df.collect()]
    assert [(c, x, t) for _, _, c, x, t, _ in rows[0]] == [
        ("general", "first", []),
        ("general", "cut  here", ["a", "b", "c"]),
        ("two words", "spaced", []),
        ("two words", "two ` open", []),
        ("two words", "x", []),
        ("été", "``", []),
        ("été", "", ["t"]),
    ]
    assert [e[0] for e in rows[0]] == [f"user-{k}" for k in range(1, 8)]
    assert rows[1:3] == [[], []] and rows[3] == [("user-1", "user", "general", "a", [], 0)]


@pytest.mark.parametrize(
    ("entry", "ok"),
    [
        ({"id": "a", "content": "c"}, True),
        ({"id": "a", "content": "c", "scope": "local", "category": "k", "tags": ["t"], "usage_count": 3, "created_at": 1.5, "updated_at": 2}, True),
        ({"id": "a", "content": "c", "tags": []}, True),
        ({"id": "a", "content": "c", "tags": ["t", 1]}, False),
        ({"id": "a", "content": "c", "tags": [None]}, False),
        ({"id": "a", "content": "c", "tags": "t"}, False),
        ({"id": "a", "content": "c", "scope": "nowhere"}, False),
        ({"id": "a", "content": "c", "scope": 1}, False),
        ({"id": "a", "content": "c", "category": None}, False),
        ({"id": "a", "content": "c", "usage_count": "3"}, False),
        ({"id": "a", "content": "c", "created_at": "now"}, False),
        ({"id": 1, "content": "c"}, False),
        ({"id": "a"}, False),
        ({"content": "c"}, False),
        ([1], False),
        ("x", False),
        (None, False),
    ],
)
def test_json_entry(spark, entry, ok):
    df = spark.createDataFrame([(json.dumps({"entries": [entry, {"id": "z", "content": ""}]}),)], "t string")
    assert [e.id for e in df.select(M.json_entries(F.col("t")).alias("e")).first().e] == ["a"] * ok + ["z"]


def test_json_or_markdown(spark):
    one, md = '{"entries": [{"id": "j", "content": "x"}]}', "- m"
    files = [("both", one, md), ("json", one, None), ("md", None, md), ("broken", "{{{", md), ("empty", "", md), ("list", "[1]", md), ("none", '{"a": 1}', md), ("odd", '{"entries": 5}', md), ("nulls", None, None)]
    rows = [(f, "project", n, raw) for f, a, b in files for n, raw in (("memory.json", a), ("MEMORY.md", b), ("other.md", "- no")) if raw is not None or f == "nulls"]
    got = {(r.folder, r.id) for r in M.load_memories(spark.createDataFrame(rows, "folder string, scope string, name string, raw string")).collect()}
    assert got == {("both", "j"), ("json", "j"), ("md", "project-1"), ("broken", "project-1"), ("empty", "project-1")}


def test_round_trip_through_files(spark, tmp_path):
    entries = [(f"f{k % 7}", "local", k, f"e{k}", ("rules", "two words", "don't")[k % 3], f"inhalt {k} é", [f"t{k}", "u"][: k % 3]) for k in range(3000)]
    df = spark.createDataFrame(entries, "folder string, scope string, place int, id string, category string, content string, tags array<string>").withColumn("usage_count", F.lit(2).cast("long"))
    texts = M.memory_texts(df, "2024-01-01 00:00")
    for _ in range(2):  # written over once
        named_files.write_files(texts.withColumn("path", F.concat(F.lit(f"{tmp_path}/"), "folder", F.lit("/"), "name")))
    assert len([p for p in tmp_path.rglob("*") if p.is_file()]) == 14
    path = F.col("_metadata.file_path")
    files = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path), wholetext=True).select(F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("folder"), F.lit("local").alias("scope"), F.regexp_extract(path, "[^/]+$", 0).alias("name"), F.col("value").alias("raw"))
    kept = {f: [e for e in entries if e[0] == f][-200:] for f in {e[0] for e in entries}}
    got = {f: [] for f in kept}
    for r in M.load_memories(files).orderBy("folder", "place").collect():
        got[r.folder].append((r.id, r.scope, r.category, r.content, r.tags, r.usage_count))
    assert got == {f: [(e[3], "local", e[4], e[5], e[6], 2) for e in es] for f, es in kept.items()}
    only_md = M.load_memories(files.where("name = 'MEMORY.md'"))
    assert {f: sorted((e[4], e[5], e[6]) for e in es) for f, es in kept.items()} == {f: sorted((r.category, r.content, r.tags) for r in only_md.where(F.col("folder") == f).collect()) for f in kept}
    assert (tmp_path / "f0/MEMORY.md").read_text().startswith("# Local Memory\n\n*Last updated: 2024-01-01 00:00*\n\n## ")


def test_a_file_without_a_path_raises(spark):
    with pytest.raises(Exception, match="needs a path"):
        named_files.write_files(spark.createDataFrame([(None, "x")], "path string, raw string"))


PROFILE = "intro\n## preferences\n- **Language**: de \n- **language**:  fr\n-  **Auto Format**: YES\n- **Verbosity**:\nfree\n## Coding Style\n- **Indent Size**: four\n- **Max Line Length**: 1_00\n- **Semicolons**: 1\n##   Common Patterns\n- one\n-two\n - **three**: x\n## Preferences\n- **Response Style**: casual\n## Project Context\n\n some text\n\nmore \n## Other\n- **language**: en\n## Custom Instructions"


def test_profile(spark):
    r = spark.createDataFrame([(PROFILE,)], "t string").select(profiles.parse(F.col("t")).alias("p")).first().p
    assert r.preferences.asDict() == dict.fromkeys(profiles.PREFERENCES, "") | {"response_style": "casual", "auto_format": False}
    assert r.coding_style.asDict() == dict.fromkeys(profiles.CODING_STYLE, "") | {"indent_size": 0, "max_line_length": 100, "semicolons": True, "trailing_comma": False}
    assert r.common_patterns == ["one", "**three**: x"] and r.project_context == "some text\n\nmore" and r.custom_instructions == ""
    first = spark.createDataFrame([(PROFILE.split("## Coding")[0],)], "t string").select(profiles.parse(F.col("t")).alias("p")).first().p.preferences
    assert (first.language, first.auto_format, first.verbosity) == ("fr", True, "")


word = st.text("abcXYZéß- 09_.", min_size=0, max_size=8).map(str.strip)
profile = st.fixed_dictionaries(
    {s: st.fixed_dictionaries({k: {"string": word, "int": st.integers(0, 999), "boolean": st.booleans()}[t] for k, t in kinds.items()}) for s, kinds in (("preferences", profiles.PREFERENCES), ("coding_style", profiles.CODING_STYLE))}
    | {"common_patterns": st.lists(word.filter(bool), max_size=3), "project_context": word, "custom_instructions": word}
)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(profile, min_size=30, max_size=30))
def test_profiles_round_trip(spark, rows):
    kinds = [f"{s}: struct<{','.join(f'{k}:{t}' for k, t in d.items())}>" for s, d in (("preferences", profiles.PREFERENCES), ("coding_style", profiles.CODING_STYLE))]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, p struct<{', '.join(kinds)}, common_patterns: array<string>, project_context: string, custom_instructions: string>")
    back = df.select("i", profiles.parse(profiles.render(F.col("p"))).alias("p")).orderBy("i").collect()
    assert [r.p.asDict(recursive=True) for r in back] == rows
