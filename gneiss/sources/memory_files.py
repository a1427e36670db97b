"""Sources and sinks of entry files: JSON with repair, Markdown profiles, skills, compressed texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.functions.arrays import let

#: Fixed value: the scopes that an entry may have.
SCOPES = ("user", "project", "local")
ENTRY = "id string, scope string, category string, content string, tags array<string>, usage_count int"


def parse_entries(rows: DataFrame, json: str) -> DataFrame:
    """Entries of a column of JSON texts, and ``problem``: why one isn't valid, else null."""
    e = F.from_json(json, F.lit(ENTRY), {"mode": "PERMISSIVE"})
    rows = rows.withColumn("e", e)
    problem = F.when(F.col("e").isNull() | F.try_parse_json(json).isNull(), "no JSON").when(F.coalesce(F.col("e.id"), F.lit("")) == "", "no id").when(F.coalesce(F.col("e.content"), F.lit("")) == "", "no content").when(~F.coalesce(F.col("e.scope").isin(*SCOPES), F.lit(False)), "bad scope")
    return rows.withColumn("problem", problem)


def recover(entries: DataFrame) -> DataFrame:
    """Valid entries: a missing category becomes general; of equal ids the first by seq stays."""
    rows = entries.where("problem IS NULL").select("seq", "e.*").withColumn("category", F.coalesce("category", F.lit("general")))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).where("n = 1").drop("n")


def profile(markdown: Column) -> Column:
    """The ``- **key**: value`` lines of a Markdown profile, as a map."""
    pairs = F.regexp_extract_all(markdown, F.lit(r"(?m)^- \*\*[^*]+\*\*: .*$"), F.lit(0))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"\*\*([^*]+)\*\*", 1), F.regexp_extract(p, r"\*\*: (.*)$", 1))))


def skill_description(markdown: Column) -> Column:
    """The first line of text that is no heading."""
    return F.get(F.filter(T.trimmed_lines(markdown), lambda x: ~F.startswith(x, F.lit("#"))), 0)


#: Titles of a scope's Markdown file, and how many entries it holds.
TITLES = {"user": "User Memory", "project": "Project Memory", "local": "Local Memory"}
MOST = 200
ITEM = "struct<id:string,scope:string,category:string,content:string,tags:array<string>,usage_count:bigint>"
#: White space as Unicode has it, and control characters that count as such.
SPACE = r"[\s\x1c-\x1f]"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def markdown_entries(markdown: Column, scope: Column) -> Column:
    """The ``- item`` lines of a Markdown memory as entries, in order.

    A line ``## name`` sets the category, in lower case, of those that follow; it is general before the first. Words in backticks are tags and leave the content. Identifiers count from 1 after the scope. Other lines (headings, ``*`` notes, free text) are left out; a null text has none. Texts are cut at headings, so work grows with the length alone.
    """
    sections = F.split(F.coalesce(markdown, F.lit("")), r"(?U)(?<![^\n])(?=[^\S\n]*## [^\n]*[^\s\x1c-\x1f])")

    def entry(item: Column, category: Column) -> Column:
        marked = F.contains(item, F.lit("`"))
        words = F.flatten(F.transform(F.regexp_extract_all(item, F.lit("`([^`]+)`"), F.lit(1)), lambda t: F.filter(F.split(t, rf"(?U){SPACE}+"), lambda w: w != "")))
        content = F.when(marked, _strip(F.regexp_replace(item, "`[^`]+`", ""))).otherwise(item)
        return F.struct(category.alias("category"), content.alias("content"), words.alias("tags"))

    def of_lines(lines: Column) -> Column:
        first = lines[0]
        category = F.when(F.startswith(first, F.lit("## ")), F.lower(_strip(F.substring(first, 4, 1 << 30)))).otherwise("general")
        items = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("- "))), lambda x: F.substring(x, 3, 1 << 30))
        return let(category, lambda c: F.transform(items, lambda x: entry(x, c)))

    def entries(section: Column) -> Column:
        return let(F.transform(F.split(section, "\n"), _strip), of_lines)

    rows = F.flatten(F.transform(sections, entries))
    numbered = F.transform(rows, lambda e, i: F.struct(F.concat(scope, F.lit("-"), (i + 1).cast("string")).alias("id"), scope.alias("scope"), e["category"].alias("category"), e["content"].alias("content"), e["tags"].alias("tags"), F.lit(0).cast("long").alias("usage_count")))
    return numbered.cast(f"array<{ITEM}>")


def json_entries(json: Column) -> Column:
    """The valid entries of a JSON memory, in order; null if the text is no JSON, none if it has no list of entries.

    An entry is an object with a string ``id`` and ``content``; scope, category, tags, usage count and times may be missing but must be of their types. Objects with a repeated key are no JSON here.
    """
    kind = lambda e, path: F.schema_of_variant(F.try_variant_get(e, path, "variant"))
    number = r"^(BIGINT|BOOLEAN|DOUBLE|DECIMAL.*)$"

    def valid(e: Column) -> Column:
        ok = F.startswith(F.schema_of_variant(e), F.lit("OBJECT"))
        for name in ("id", "content"):
            ok &= F.coalesce(kind(e, f"$.{name}") == "STRING", F.lit(False))
        for name, pattern in (("scope", "^STRING$"), ("category", "^STRING$"), ("created_at", number), ("updated_at", number), ("tags", "^ARRAY"), ("usage_count", "^(BIGINT|BOOLEAN)$")):
            ok &= F.coalesce(kind(e, f"$.{name}").rlike(pattern), F.lit(True))
        ok &= F.coalesce(F.try_variant_get(e, "$.scope", "string").isin(*SCOPES), F.lit(True))
        return ok & F.coalesce(F.forall(F.try_variant_get(e, "$.tags", "array<variant>"), lambda t: F.schema_of_variant(t) == "STRING"), F.lit(True))

    def entry(e: Column) -> Column:
        text = lambda name: F.try_variant_get(e, f"$.{name}", "string")
        return F.struct(text("id").alias("id"), F.coalesce(text("scope"), F.lit("user")).alias("scope"), F.coalesce(text("category"), F.lit("general")).alias("category"), text("content").alias("content"), F.coalesce(F.try_variant_get(e, "$.tags", "array<string>"), F.array()).alias("tags"), F.coalesce(F.try_variant_get(e, "$.usage_count", "bigint"), F.lit(0)).alias("usage_count"))

    parsed = F.try_parse_json(json)
    found = F.coalesce(F.try_variant_get(parsed, "$.entries", "array<variant>"), F.array().cast("array<variant>"))
    return F.when(parsed.isNotNull(), F.transform(F.filter(found, valid), entry).cast(f"array<{ITEM}>"))


def load_memories(files: DataFrame) -> DataFrame:
    """(folder, place, entry columns) of memory files (folder, scope, name, raw): a folder's ``memory.json``, or its ``MEMORY.md`` where that is missing or no JSON. Files of other names are left out; a folder is one row a kind of file before its entries are."""
    own = files.where(F.col("name").isin("memory.json", "MEMORY.md"))
    both = own.groupBy("folder").agg(F.min("scope").alias("scope"), *[F.max(F.when(F.col("name") == n, F.col("raw"))).alias(c) for n, c in (("memory.json", "json"), ("MEMORY.md", "md"))])
    entries = F.coalesce(json_entries(F.col("json")), markdown_entries(F.col("md"), F.col("scope")))
    return both.select("folder", F.posexplode(entries).alias("place", "e")).select("folder", "place", "e.*")


def _titled(x: Column) -> Column:
    """Every run of letters with a capital first."""
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), F.initcap), "")


def memory_texts(entries: DataFrame, updated: str) -> DataFrame:
    """(folder, scope, name, raw): the two files of every folder of entries (folder, scope, place, id, category, content, tags, usage_count), with the last ``MOST`` by place. ``updated`` is the time that the Markdown shows."""
    last = Window.partitionBy("folder").orderBy(F.desc("place"))
    kept = entries.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= MOST)
    e = F.struct("place", "id", "category", "content", F.coalesce("tags", F.array()).alias("tags"), "usage_count")
    rows = kept.groupBy("folder").agg(F.min("scope").alias("scope"), F.sort_array(F.collect_list(e)).alias("e"))
    title = F.coalesce(*[F.when(F.col("scope") == k, v) for k, v in TITLES.items()], F.lit("Memory"))

    def item(x: Column) -> Column:
        return F.concat(F.lit("- "), x["content"], F.when(F.size(x["tags"]) > 0, F.concat(F.lit(" `"), F.array_join(x["tags"], " "), F.lit("`"))).otherwise(""))

    def section(category: Column) -> Column:
        items = F.transform(F.filter("e", lambda x: x["category"] == category), item)
        return F.concat(F.array(F.concat(F.lit("## "), _titled(category)), F.lit("")), items, F.array(F.lit("")))

    head = F.array(F.concat(F.lit("# "), title), F.lit(""), F.lit(f"*Last updated: {updated}*"), F.lit(""))
    md = F.array_join(F.concat(head, F.flatten(F.transform(F.array_distinct(F.transform("e", lambda x: x["category"])), section))), "\n")
    json = F.to_json(F.struct("scope", F.lit(updated).alias("last_updated"), F.transform("e", lambda x: F.struct(x["id"].alias("id"), F.col("scope"), *[x[c].alias(c) for c in ("category", "content", "tags", "usage_count")])).alias("entries")))
    return rows.select("folder", "scope", F.inline(F.array(F.struct(F.lit("memory.json").alias("name"), json.alias("raw")), F.struct(F.lit("MEMORY.md").alias("name"), md.alias("raw")))))
