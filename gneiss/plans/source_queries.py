"""Queries of sources: entry files, profiles, skills, sessions, small parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.plans.base import load, query, spread
from gneiss.session import shared_folder
from gneiss.sources import memory_files as M
from gneiss.sources import named_files, profiles
from gneiss.sources import sessions as S

RAW = "CASE WHEN doc_id % 11 = 0 THEN '{broken' WHEN doc_id % 7 = 0 THEN '{\"id\":\"\",\"content\":\"x\",\"scope\":\"user\"}' WHEN doc_id % 5 = 0 THEN '{\"id\":\"' || doc_id || '\",\"content\":\"x\",\"scope\":\"nowhere\"}' ELSE '{\"id\":\"' || doc_id // 2 || '\",\"content\":\"' || source || '\",\"scope\":\"user\"}' END"
PROBLEM = "CASE WHEN doc_id % 11 = 0 THEN 'no JSON' WHEN doc_id % 7 = 0 THEN 'no id' WHEN doc_id % 5 = 0 THEN 'bad scope' END"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "doc_id", F.expr(RAW.replace("doc_id // 2", "(doc_id div 2)")).alias("raw"))
    return M.parse_entries(rows, "raw")


@query(f"SELECT doc_id, {PROBLEM} AS problem FROM documents")
def memory_json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with what is wrong with them."""
    return _entries(spark, sf_dir).select("doc_id", "problem")


@query(f"SELECT CAST(doc_id // 2 AS VARCHAR) AS id, arg_min(source, doc_id) AS content, 'general' AS category FROM documents WHERE {PROBLEM} IS NULL GROUP BY doc_id // 2")
def memory_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, M3."""
    return M.recover(_entries(spark, sf_dir)).select("id", "content", "category")


@query("SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def profile_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10."""
    md = F.concat(F.lit("# Profile\n\n## Preferences\n- **name**: "), "n_name", F.lit("\n- **region**: "), F.col("n_regionkey").cast("string"), F.lit("\nfree text\n"))
    p = M.profile(md)
    return load(spark, sf_dir, "nation").select("n_nationkey", F.element_at(p, "name").alias("name"), F.element_at(p, "region").alias("region"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS language, c_custkey % 2 = 0 AS auto_format, CAST(c_custkey % 9 AS INT) AS indent_size, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS patterns, 'about ' || c_mktsegment AS context FROM customer""")
def profile_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles written as Markdown, with lines that say nothing put in, and read again."""
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    values = {"language": F.when(k % 3 == 0, "").otherwise(segment), "auto_format": k % 2 == 0, "indent_size": (k % 9).cast("int")}
    fields = lambda kinds: F.struct(*[values.get(name, F.lit({"string": "", "int": 0, "boolean": False}[kind])).alias(name) for name, kind in kinds.items()])
    patterns = F.filter(F.array(F.col("c_name")), lambda x: k % 5 != 0)
    p = F.struct(fields(profiles.PREFERENCES).alias("preferences"), fields(profiles.CODING_STYLE).alias("coding_style"), patterns.alias("common_patterns"), F.concat(F.lit("about "), segment).alias("project_context"), F.lit("").alias("custom_instructions"))
    md = F.concat(F.replace(profiles.render(p), F.lit("## Coding Style"), F.lit("- **Unknown**: x\nfree text\n## coding style")), F.lit("## Other\n- **Language**: none\n"))
    back = spread(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")).select("c_custkey", profiles.parse(md).alias("p"))
    return back.select("c_custkey", "p.preferences.language", "p.preferences.auto_format", "p.coding_style.indent_size", F.array_join("p.common_patterns", ",").alias("patterns"), F.col("p.project_context").alias("context"))


@query("""WITH e AS (SELECT doc_id // 100 AS f, doc_id, coalesce(lang, 'none') AS category, doc_id || ' has ' || n_chars AS content, source FROM documents),
c AS (SELECT f, category, min(doc_id) AS lo FROM e GROUP BY ALL), n AS (SELECT e.*, row_number() OVER (PARTITION BY f ORDER BY lo, doc_id) - 1 AS i, row_number() OVER (PARTITION BY f ORDER BY doc_id) - 1 AS j FROM e JOIN c USING (f, category))
SELECT 'm' || f AS folder, CAST(CASE WHEN f % 3 = 0 THEN i ELSE j END AS INT) AS place, CASE WHEN f % 3 = 0 THEN 'local-' || (i + 1) ELSE 'd' || doc_id END AS id, category, content, 'from ' || source AS tags FROM n""")
def memory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories written as JSON and Markdown files, a folder a hundred documents, and read again; every third folder's JSON is broken, so its Markdown counts."""
    f = F.expr("doc_id div 100")
    entries = load(spark, sf_dir, "documents").select(F.concat(F.lit("m"), f.cast("string")).alias("folder"), F.lit("local").alias("scope"), F.col("doc_id").alias("place"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.coalesce("lang", F.lit("none")).alias("category"), F.concat(F.col("doc_id").cast("string"), F.lit(" has "), F.col("n_chars").cast("string")).alias("content"), F.array(F.lit("from"), "source").alias("tags"), F.lit(1).cast("long").alias("usage_count"))
    to = shared_folder(spark, "memories")
    broken = (F.col("name") == "memory.json") & (F.substring("folder", 2, 20).cast("long") % 3 == 0)
    texts = M.memory_texts(entries, "2024-01-01 00:00")
    named_files.write_files(texts.select(F.concat(F.lit(f"{to}/"), "folder", F.lit("/"), "name").alias("path"), F.when(broken, F.concat(F.lit("{"), "raw")).otherwise(F.col("raw")).alias("raw")))
    path = F.col("_metadata.file_path")
    files = spark.read.option("recursiveFileLookup", "true").text(to, wholetext=True).select(F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("folder"), F.lit("local").alias("scope"), F.regexp_extract(path, "[^/]+$", 0).alias("name"), F.col("value").alias("raw"))
    return M.load_memories(files).select("folder", "place", "id", "category", "content", F.array_join("tags", " ").alias("tags"))


@query("SELECT n_nationkey, 'Skill of ' || n_name AS description FROM nation")
def skill_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11."""
    return load(spark, sf_dir, "nation").select("n_nationkey", M.skill_description(F.concat(F.lit("# "), "n_name", F.lit("\n\n## Use\n  Skill of "), "n_name", F.lit("\nmore"))).alias("description"))


@query("SELECT name, min(root) AS root FROM (SELECT n_name AS name, 1 AS root FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_name, 2 FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, 3 FROM nation) GROUP BY name")
def skill_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several roots with a name, the first."""
    n = load(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    roots = F.array_compact(F.array(F.when(k % 3 == 0, 1), F.when(k % 2 == 0, 2), F.lit(3)))
    return n.select(F.col("n_name").alias("name"), F.explode(roots).alias("root")).groupBy("name").agg(F.min("root").alias("root"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def session_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions written as JSON, a row a message, and read again with a schema."""
    path = shared_folder(spark, "sessions")
    load(spark, sf_dir, "conversations").write.json(path, compression="gzip")
    back = spark.read.schema("conv_id long, turn long, role string, text string").json(path)
    return back.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"))


def _stored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files of a store, written and read again: four turns a file, deltas with the turn before them too; every fifth has a broken delta as well, every seventh a broken file of its own."""
    turns = load(spark, sf_dir, "conversations")
    in_parts = turns.select("*", F.explode(F.when(F.col("turn") % 4 == 3, F.expr("array(turn div 4, turn div 4 + 1)")).otherwise(F.expr("array(turn div 4)"))).alias("part"))
    files = in_parts.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    sid = F.col("conv_id").cast("string")
    own = F.to_json(F.struct(sid.alias("session_id"), (F.col("conv_id") / 4).alias("created_at"), (F.col("conv_id") % 100).cast("double").alias("updated_at"), F.lit("/work").alias("workspace"), "messages"))
    delta = F.to_json(F.struct((F.col("part") * 4 - 1).alias("msg_offset"), "messages"))
    first = F.col("part") == 0
    path = F.when(first, F.concat(F.lit("/store/"), sid, F.lit(".json"))).otherwise(F.concat(F.lit("/store/deltas/"), sid, F.lit("/delta_"), F.lpad(F.col("part").cast("string"), 4, "0"), F.lit(".json")))
    raw = F.when(~first, delta).when(F.col("conv_id") % 7 == 0, F.concat(F.lit("{"), own)).otherwise(own)
    broken = files.where(first & (F.col("conv_id") % 5 == 0)).select(F.concat(F.lit("/store/deltas/"), sid, F.lit("/delta_0000.json")).alias("path"), F.left(own, F.lit(20)).alias("raw"))
    to = shared_folder(spark, "store")
    files.select(path.alias("path"), raw.alias("raw")).unionByName(broken).write.parquet(to)
    return S.parts(spark.read.parquet(to))


@query("SELECT CAST(conv_id AS VARCHAR) AS session, turn AS place, role, text AS content FROM conversations WHERE conv_id % 7 <> 0")
def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from their own files and deltas, overlaps once, broken files left out."""
    return S.messages(_stored_sessions(spark, sf_dir))


@query("""SELECT CAST(conv_id AS VARCHAR) AS session, conv_id / 4 AS created_at, CAST(conv_id % 100 AS DOUBLE) AS updated_at, '/work' AS workspace, count(*) AS message_count,
coalesce(left(arg_min(text, turn) FILTER (WHERE role = 'user'), 100), '') AS first_message, coalesce(left(arg_max(text, turn) FILTER (WHERE role IN ('user', 'assistant')), 100), '') AS last_message
FROM conversations WHERE conv_id % 7 <> 0 GROUP BY conv_id""")
def session_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a session; `refresh_index` keeps it for a folder of files."""
    return S.index(_stored_sessions(spark, sf_dir))


@query("SELECT doc_id, CAST(n_chars AS BIGINT) AS chars FROM documents")
def compressed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through compressed CSV files."""
    path = shared_folder(spark, "csv")
    load(spark, sf_dir, "documents").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("t")).select("doc_id", F.regexp_replace("t", "\r\n", "").alias("t")).write.csv(path, header=True, compression="gzip")
    back = spark.read.schema("doc_id long, t string").csv(path, header=True)
    return back.select("doc_id", F.length(F.decode(F.unbase64("t"), "UTF-8")).cast("long").alias("chars"))


@query("SELECT c_custkey, field, value FROM (SELECT c_custkey, 'segment' AS field, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'name', c_name FROM customer) WHERE contains(lower(value), 'build')")
def preference_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of several attributes, whatever the case."""
    wide = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    return wide.unpivot("c_custkey", ["segment", "name"], "field", "value").where(F.contains(F.lower("value"), F.lit("build")))


@query("SELECT n_name AS command FROM nation WHERE starts_with(n_name, 'NATION_1') OR starts_with(n_name, 'A')")
def slash_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: commands with a prefix."""
    n = F.col("n_name")
    return load(spark, sf_dir, "nation").where(F.startswith(n, F.lit("NATION_1")) | F.startswith(n, F.lit("A"))).select(n.alias("command"))


@query("""SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'project' WHEN item_id % 3 = 1 THEN 'user' END AS scope, CASE WHEN item_id % 3 < 2 THEN text END AS content FROM benchmark""")
def memory_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: ``# x`` and ``/memory add scope: x``."""
    x = F.col("text")
    k = F.col("item_id") % 3
    line = F.when(k == 0, F.concat(F.lit("# "), x)).when(k == 1, F.concat(F.lit("/memory add user: "), x)).otherwise(x)
    rows = load(spark, sf_dir, "benchmark").select("item_id", line.alias("line"))
    is_note, add = F.startswith("line", F.lit("# ")), r"^/memory add (user|project|local): "
    scope = F.when(is_note, "project").when(F.col("line").rlike(add), F.regexp_extract("line", add, 1))
    content = F.when(is_note, F.substring("line", 3, 1 << 30)).when(F.col("line").rlike(add), F.regexp_replace("line", add, ""))
    return rows.select("item_id", scope.alias("scope"), content.alias("content"))


@query("SELECT n_nationkey, '[' || n_name || ']' || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || chr(10) || 'even' ELSE '' END || chr(10) || chr(10) || 'end' AS prompt FROM nation")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: sections in order, those whose condition holds."""
    sections = F.array_compact(F.array(F.concat(F.lit("["), "n_name", F.lit("]")), F.when(F.col("n_nationkey") % 2 == 0, "even"), F.lit("end")))
    return load(spark, sf_dir, "nation").select("n_nationkey", F.array_join(sections, "\n\n").alias("prompt"))


@query("SELECT s_suppkey, 'c' || s_suppkey AS container, 'image' || s_nationkey AS image, CASE WHEN s_suppkey % 2 = 0 THEN 'Up' ELSE 'Exited' END AS state FROM supplier")
def container_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: rows of a listing whose columns are parted by two or more spaces."""
    k = F.col("s_suppkey").cast("string")
    line = F.concat(F.lit("c"), k, F.lit("   image"), F.col("s_nationkey").cast("string"), F.lit("  "), F.when(F.col("s_suppkey") % 2 == 0, "Up").otherwise("Exited"), F.lit(" 2 hours"))
    cells = F.split("line", r"\s{2,}")
    return load(spark, sf_dir, "supplier").select("s_suppkey", line.alias("line")).select("s_suppkey", cells[0].alias("container"), cells[1].alias("image"), F.split_part(cells[2], F.lit(" "), F.lit(1)).alias("state"))


@query("SELECT page_id, 'item ' || page_id AS title, url AS link, left('text of ' || page_id || repeat('.', 300), 200) AS description FROM pages")
def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items of feeds, here made of pages."""
    k = F.col("page_id").cast("string")
    item = F.concat(F.lit("<item><title>item "), k, F.lit("</title><link>"), "url", F.lit("</link><description>text of "), k, F.repeat(F.lit("."), F.lit(300)), F.lit("</description></item>"))
    rows = load(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(F.concat(F.lit("<rss>"), item, F.lit("</rss>")), F.lit("(?s)<item>(.*?)</item>"), F.lit(1))).alias("i"))
    part = lambda tag: F.regexp_extract("i", f"(?s)<{tag}>(.*?)</{tag}>", 1)
    return rows.select("page_id", part("title").alias("title"), part("link").alias("link"), F.left(part("description"), F.lit(200)).alias("description"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS different, true AS right_length FROM nation")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """random identifiers and strings; what is fixed about them."""
    rows = load(spark, sf_dir, "nation").select(F.uuid().alias("u"), F.randstr(F.lit(16), F.lit(1)).alias("s"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("u").alias("different"), F.bool_and((F.length("u") == 36) & (F.length("s") == 16)).alias("right_length"))


@query("""SELECT page_id, url FROM (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages) WHERE NOT regexp_matches(path, '(^|/)(\\.git|node_modules|__pycache__|de)(/|$)') AND NOT regexp_matches(path, '(^|/)\\.') AND NOT regexp_matches(path, '\\.(png|jpg|zip|exe)$')""")
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths without skipped folders, hidden names and binary endings."""
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return load(spark, sf_dir, "pages").where(~path.rlike(r"(^|/)(\.git|node_modules|__pycache__|de)(/|$)") & ~path.rlike(r"(^|/)\.") & ~path.rlike(r"\.(png|jpg|zip|exe)$")).select("page_id", "url")


@query("SELECT doc_id, CAST(n_chars AS BIGINT) AS chars FROM documents")
def text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts replaced and written through the committer, which makes files visible at once, and read again."""
    path = shared_folder(spark, "texts")
    load(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("the"), F.lit("THE")).alias("text")).write.parquet(path)
    return spark.read.parquet(path).select("doc_id", F.length("text").cast("long").alias("chars"))
