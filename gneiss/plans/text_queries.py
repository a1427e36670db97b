"""Queries over texts and pages: lines, patterns, cuts, encodings, markup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import delimited, edits, regex
from gneiss.functions import json as J
from gneiss.functions import text as T
from gneiss.plans.base import any_hit, load, query

LINES_SQL = "(SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"
CJK_SQL = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]"
WIDE_SQL = r"[\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}]"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))


@query(f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM {LINES_SQL} WHERE regexp_matches(line, '(?i)\\b(licensed|copyright)\\b')")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that match, whatever the case."""
    return _lines(spark, sf_dir).where(F.col("line").rlike(r"(?i)\b(licensed|copyright)\b")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"""WITH l AS (SELECT doc_id, line_no, line, list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b,
 list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a FROM {LINES_SQL})
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line, coalesce(array_to_string(b, chr(10)), '') AS context_before, coalesce(array_to_string(a, chr(10)), '') AS context_after FROM l WHERE regexp_matches(line, '(?i)licensed under')""")
def grep_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with two lines of context; from the array of a text's lines, so without a shuffle."""
    docs = load(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("s"))
    at = F.col("line_no")
    hit = docs.select("doc_id", "s", F.posexplode("s").alias("line_no", "line")).where(F.col("line").rlike("(?i)licensed under"))
    before = F.slice("s", F.greatest(at - 1, F.lit(1)), F.least(at, F.lit(2)))
    after = F.slice("s", at + 2, F.lit(2))
    return hit.select("doc_id", at.cast("long").alias("line_no"), "line", F.concat_ws("\n", before).alias("context_before"), F.concat_ws("\n", after).alias("context_after"))


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM {LINES_SQL} WHERE contains(line, 'the') AND NOT starts_with(line, '#'))
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM l WHERE k <= 20""")
def find_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 lines of a text that hold a name and are no comment."""
    docs = load(spark, sf_dir, "documents")
    found = F.slice(F.filter(F.transform(T.lines(F.col("text")), lambda x, i: F.struct(i.cast("long").alias("line_no"), x.alias("line"))), lambda x: F.contains(x["line"], F.lit("the")) & ~F.startswith(x["line"], F.lit("#"))), 1, 20)
    return docs.select("doc_id", F.inline(found))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://.*example\\.org/.*$') AND NOT regexp_matches(url, '^.*utm_.*$')")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclude first, then include; * crosses /."""
    u = F.col("url")
    return load(spark, sf_dir, "pages").where(~u.rlike(T.glob_regex("*utm_*")) & u.rlike(T.glob_regex("https://*example.org/*"))).select("page_id", "url")


@query("""SELECT doc_id, CAST(len(s) AS BIGINT) AS total, CAST(len(list_filter(s, lambda x: trim(x, chr(32)||chr(9)||chr(10)||chr(13)) <> '')) AS BIGINT) AS non_empty,
CAST(len(list_filter(s, lambda x: trim(x, chr(32)||chr(9)||chr(10)||chr(13)) = '')) AS BIGINT) AS empty, CAST(length(text) AS BIGINT) AS chars FROM (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM documents)""")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G18."""
    s = T.lines(F.col("text"))
    full = F.size(F.filter(s, lambda x: F.trim(x, F.lit(" \t\n\r")) != ""))
    return load(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("total"), full.cast("long").alias("non_empty"), (F.size(s) - full).cast("long").alias("empty"), F.length("text").cast("long").alias("chars"))


@query("""SELECT doc_id, array_to_string(list_concat(list_sort(list_filter(s, lambda x: x <> '')), list_filter(s, lambda x: x = '')), chr(10)) AS sorted FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS s FROM documents)""")
def text_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: a text's lines in order, blank ones last."""
    s = T.lines(F.lower("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", F.concat(F.array_sort(F.filter(s, lambda x: x != "")), F.filter(s, lambda x: x == ""))).alias("sorted"))


TRIMMED_SQL = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


@query(f"""WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, {TRIMMED_SQL} AS s FROM documents)),
f AS (SELECT doc_id, line, min(i) AS i FROM l GROUP BY ALL)
SELECT doc_id, CAST(count(line) AS BIGINT) AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS deduped FROM (SELECT d.doc_id, f.line, f.i FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id) GROUP BY doc_id""")
def text_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines trimmed, blank and repeated ones dropped, first ones kept in place."""
    s = F.array_distinct(T.trimmed_lines(F.col("text")))
    return load(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n_lines"), F.concat_ws("\n", s).alias("deduped"))


@query(f"SELECT doc_id, array_to_string({TRIMMED_SQL}, ', ') AS joined FROM documents")
def text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5."""
    return load(spark, sf_dir, "documents").select("doc_id", F.concat_ws(", ", T.trimmed_lines(F.col("text"))).alias("joined"))


@query("SELECT doc_id, substring(text, 101, 200) AS slice, CAST(least(length(text), 300) AS BIGINT) AS end_at, CAST(length(text) AS BIGINT) AS total, length(text) > 300 AS truncated FROM documents")
def read_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters 100 to 300 with their header."""
    n = F.length("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.substring("text", 101, 200).alias("slice"), F.least(n, F.lit(300)).cast("long").alias("end_at"), n.cast("long").alias("total"), (n > 300).alias("truncated"))


@query("""SELECT doc_id, CASE WHEN len(s) > 8 THEN array_to_string(list_concat(s[1:3], ['... [' || (len(s) - 5) || ' lines omitted] ...'], s[-2:]), chr(10)) ELSE text END AS short FROM (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM documents)""")
def smart_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head and tail lines around a note."""
    return load(spark, sf_dir, "documents").select("doc_id", T.head_tail(F.col("text"), 8, 3, 2).alias("short"))


@query("""SELECT doc_id, CASE WHEN length(text) > 1000 THEN left(text, 600) || chr(10) || '... [' || (length(text) - 1000) || ' characters omitted] ...' || chr(10) || right(text, 400) ELSE text END AS short FROM documents""")
def output_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 % head, 40 % tail."""
    return load(spark, sf_dir, "documents").select("doc_id", T.middle_cut(F.col("text"), 1000).alias("short"))


@query("""SELECT doc_id, CAST(len(m) AS BIGINT) AS n_matches, array_to_string(m, '|') AS matches, coalesce(m[1], '') AS first FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{3,}') AS m FROM documents)""")
def regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1."""
    m = F.regexp_extract_all("text", F.lit("[0-9]{3,}"), F.lit(0))
    return load(spark, sf_dir, "documents").select("doc_id", F.size(m).cast("long").alias("n_matches"), F.concat_ws("|", m).alias("matches"), F.coalesce(F.get(m, 0), F.lit("")).alias("first"))


SPAN = "(?P<capital>[A-Z])([a-z]*)ing"


@query("""WITH m AS (SELECT doc_id, regexp_extract_all(text, '([A-Z])([a-z]*)ing') AS m, regexp_extract_all(text, '([A-Z])([a-z]*)ing', 1) AS a, regexp_extract_all(text, '([A-Z])([a-z]*)ing', 2) AS b, list_transform(regexp_split_to_array(text, '([A-Z])([a-z]*)ing'), lambda x: length(x)) AS gaps FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)
SELECT doc_id, CAST(i AS INT) AS n, m[i] AS match, CAST(list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, CAST(list_sum(gaps[1:i]) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT) AS stop, a[i] AS capital, b[i] AS middle FROM r""")
def regex_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every match with its span, groups and named groups."""
    m = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(regex.all_matches(F.col("text"), SPAN)).alias("i", "m"))
    return m.select("doc_id", (F.col("i") + 1).alias("n"), "m.match", "m.start", "m.stop", F.element_at("m.named", "capital").alias("capital"), F.get("m.groups", 1).alias("middle"))


@query("""WITH a AS (SELECT doc_id, text, left(text, 12) AS head FROM documents WHERE text <> ''), b AS (SELECT *, contains(substring(text, 2), head) AS twice FROM a),
c AS (SELECT *, 'HEAD' || substring(text, length(head) + 1) AS t1 FROM b)
SELECT doc_id, CAST(CASE WHEN twice THEN 0 WHEN contains(t1, 'the ') THEN 2 ELSE 1 END AS INT) AS applied, CAST(CASE WHEN twice THEN 1 WHEN NOT contains(t1, 'the ') THEN 2 END AS INT) AS failed,
CASE WHEN twice THEN 'ambiguous' WHEN NOT contains(t1, 'the ') THEN 'not found' END AS problem, CASE WHEN twice OR NOT contains(t1, 'the ') THEN text ELSE replace(t1, 'the ', 'THE ') END AS edited FROM c""")
def edit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits a text, the first one of its first twelve characters, which must be there only once."""
    t = F.col("text")
    todo = F.array(F.struct(F.left(t, F.lit(12)).alias("search"), F.lit("HEAD").alias("replace"), F.lit(False).alias("all")), F.struct(F.lit("the ").alias("search"), F.lit("THE ").alias("replace"), F.lit(True).alias("all")))
    done = load(spark, sf_dir, "documents").where(t != "").select("doc_id", edits.apply_edits(t, todo).alias("r"))
    return done.select("doc_id", "r.applied", "r.failed", "r.problem", F.col("r.text").alias("edited"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN '"' || event_type || '"' WHEN 7 THEN '["a","' || event_type || '","c"]' END AS value,
CASE event_id % 8 WHEN 2 THEN 'invalid path' WHEN 3 THEN 'not found' WHEN 4 THEN 'cannot index' WHEN 5 THEN 'not found' WHEN 6 THEN 'invalid JSON' END AS problem FROM events""")
def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a path for each row through nested JSON, some of it broken."""
    kind = F.col("event_id") % 8
    raw = F.concat(F.lit('{"user": {"id": '), F.col("user_id").cast("string"), F.lit(', "tags": ["a", "'), "event_type", F.lit('", "c"]}, "v": null, "props": '), "props", F.when(kind == 6, "").otherwise("}"))
    paths = ("user.id", "user.tags.-2", "user.tags.3", "v", "props.k.x", "missing", "user.id", "user.tags")
    return load(spark, sf_dir, "events").select("event_id", J.walk(raw, F.get(F.array(*map(F.lit, paths)), kind.cast("int"))).alias("w")).select("event_id", "w.value", "w.problem")


@query("""SELECT event_id, '{' || chr(10) || '  "k": ' || CAST(json_extract_string(props, '$.k') AS BIGINT) || ',' || chr(10) || '  "none": [],' || chr(10) || '  "in": [' || chr(10) || '    "' || event_type || '"' || chr(10) || '  ]' || chr(10) || '}' AS layout FROM events""")
def json_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON a line a member."""
    raw = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(',"none":[ ],"in":["'), "event_type", F.lit('"]}'))
    return load(spark, sf_dir, "events").select("event_id", J.pretty(raw).alias("layout"))


@query(f"SELECT doc_id, CAST(line_no AS VARCHAR) AS n, CASE WHEN line_no % 3 <> 2 THEN line END AS line FROM {LINES_SQL}")
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited text of each document's lines, its delimiter by row, some rows short or long, read as records by its header."""
    d = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = F.transform(T.lines(F.col("text")), lambda x, i: F.concat(i.cast("string"), F.when(i % 3 == 2, "").otherwise(F.concat(d, F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'), F.when(i % 3 == 1, F.concat(d, F.lit("more"))).otherwise("")))))
    raw = F.concat(F.lit("n"), d, F.lit("line\r\n"), F.array_join(rows, "\n"))
    records = load(spark, sf_dir, "documents").select("doc_id", F.explode(delimited.records_of(delimited.rows_of(raw, d))).alias("r"))
    return records.select("doc_id", F.try_element_at("r", F.lit("n")).alias("n"), F.try_element_at("r", F.lit("line")).alias("line"))


@query("""SELECT conv_id, 'turn;role;text' || chr(13) || chr(10) || string_agg(turn || ';' || role || ';' || CASE WHEN regexp_matches(text, '[";\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END || chr(13) || chr(10), '' ORDER BY turn) AS csv FROM conversations GROUP BY conv_id""")
def csv_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays of objects as delimited texts, one a conversation."""
    turns = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("turn", "role", "text")))).alias("json"))
    return turns.select("conv_id", delimited.text_of(F.col("json"), F.lit(";"))["text"].alias("csv"))


@query("SELECT doc_id, regexp_replace(text, '([a-z]+)@([a-z]+)', '\\2 at \\1', 'g') AS replaced, CAST(len(regexp_extract_all(text, '([a-z]+)@([a-z]+)')) AS BIGINT) AS n FROM documents")
def regex_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2."""
    return load(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "([a-z]+)@([a-z]+)", "$2 at $1").alias("replaced"), F.regexp_count("text", F.lit("([a-z]+)@([a-z]+)")).cast("long").alias("n"))


@query("""SELECT doc_id, lang, CAST(source AS VARCHAR) AS source, n_chars, doc_id || ',' || lang || ',' || source || ',' || n_chars AS row_text FROM documents""")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to CSV and back; values are read as strings and typed by the schema."""
    docs = load(spark, sf_dir, "documents").select(F.to_csv(F.struct("doc_id", "lang", "source", "n_chars")).alias("row_text"))
    return docs.select(F.from_csv("row_text", F.lit("doc_id long, lang string, source string, n_chars long")).alias("r"), "row_text").select("r.*", "row_text")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'not found') AS missing FROM events")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4."""
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("not found")).alias("missing"))


@query("SELECT event_id, json_valid(props) AS valid, coalesce(json_type(props, '$.k') IN ('UBIGINT', 'BIGINT'), false) AS k_is_number FROM events")
def json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is JSON and has a required key of a type."""
    v = F.try_parse_json("props")
    return load(spark, sf_dir, "events").select("event_id", v.isNotNull().alias("valid"), F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.k", "variant")) == "BIGINT", F.lit(False)).alias("k_is_number"))


@query("SELECT doc_id, base64(encode(text)) AS encoded, decode(from_base64(base64(encode(text)))) AS decoded FROM documents")
def base64_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7; the encoded text has no line ends."""
    e = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "\r\n", "")
    return load(spark, sf_dir, "documents").select("doc_id", e.alias("encoded"), F.decode(F.unbase64(e), "UTF-8").alias("decoded"))


@query("SELECT page_id, replace(url_encode(url), '%2F', '/') AS encoded, url_decode(url_encode(url)) AS decoded FROM pages")
def url_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7."""
    e = T.percent_encode(F.col("url"))
    return load(spark, sf_dir, "pages").select("page_id", e.alias("encoded"), T.percent_decode(e).alias("decoded"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, left(sha256(text), 12) AS short_hash FROM documents")
def text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, F24."""
    return load(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"), F.left(F.sha2("text", 256), F.lit(12)).alias("short_hash"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS unix, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def ts_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """to Unix seconds and to ISO, whatever the session's time zone."""
    ntz = F.col("ts").cast("timestamp_ntz")
    return load(spark, sf_dir, "events").select("event_id", (F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")).cast("long").alias("unix"), F.date_format(ntz, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


HTML_SQL = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, {HTML_SQL} AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10."""
    return load(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("SELECT page_id, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is') AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11."""
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


@query("""SELECT page_id, unnest(hrefs) AS href, CAST(generate_subscripts(hrefs, 1) - 1 AS BIGINT) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages)""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12."""
    return load(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href")).select("page_id", "href", F.col("pos").cast("long").alias("pos"))


ALLOWED, BLOCKED = ("example.org", "example.com"), ("tion.example.com",)
HOST_SQL = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
_under = lambda host, names: "(" + " OR ".join(f"{host} = '{d}' OR ends_with({host}, '.{d}')" for d in names) + ")"


@query(f"SELECT page_id, {HOST_SQL} AS host, NOT {_under(HOST_SQL, BLOCKED)} AND {_under(HOST_SQL, ALLOWED)} AS allowed FROM pages")
def url_domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blocked domains first, then allowed ones; equal or under a dot."""
    host = F.lower(F.parse_url("url", F.lit("HOST")))
    under = lambda names: F.exists(F.array(*map(F.lit, names)), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    return load(spark, sf_dir, "pages").select("page_id", host.alias("host"), (~under(BLOCKED) & under(ALLOWED)).alias("allowed"))


PRIVATE = ("localhost", "127.", "10.", "192.168.", "169.254.", "0.0.0.0")


@query(f"SELECT page_id, (starts_with(url, 'http://') OR starts_with(url, 'https://')) AND NOT ({' OR '.join(f'starts_with({HOST_SQL}, {p!r})' for p in PRIVATE)}) AS safe FROM pages")
def safe_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14."""
    host, u = F.lower(F.parse_url("url", F.lit("HOST"))), F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", ((F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://"))) & ~F.exists(F.array(*map(F.lit, PRIVATE)), lambda p: F.startswith(host, p))).alias("safe"))


@query("""SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n, md5(replace(text, 'the', 'THE')) AS replaced_md5,
md5(CASE WHEN strpos(text, 'the') > 0 THEN left(text, strpos(text, 'the') - 1) || 'THE' || substring(text, strpos(text, 'the') + 3) ELSE text END) AS once_md5 FROM documents""")
def replace_all_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replace all, replace once, count."""
    t = F.col("text")
    at = F.locate("the", t)
    once = F.when(at > 0, F.overlay(t, F.lit("THE"), at, F.lit(3))).otherwise(t)
    return load(spark, sf_dir, "documents").select("doc_id", T.occurrences(t, "the").alias("n"), F.md5(F.replace(t, F.lit("the"), F.lit("THE"))).alias("replaced_md5"), F.md5(once).alias("once_md5"))


@query("""SELECT doc_id, change, CAST(n AS BIGINT) AS n, CASE WHEN n = 0 THEN 'not found' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM
(SELECT doc_id, c.change, CAST((length(text) - length(replace(text, c.old, ''))) / length(c.old) AS BIGINT) AS n FROM documents, (VALUES (1, 'License'), (2, 'the '), (3, 'under')) c(change, old))""")
def multi_edit_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what each change would do to each text; the few changes are an array, so no join."""
    changes = ((1, "License"), (2, "the "), (3, "under"))
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("change"), T.occurrences(F.col("text"), old).alias("n")) for k, old in changes]))
    return load(spark, sf_dir, "documents").select("doc_id", rows).withColumn("status", F.when(F.col("n") == 0, "not found").when(F.col("n") > 1, "ambiguous").otherwise("ok"))


@query("""SELECT doc_id, CAST(n_new - n_old AS BIGINT) AS net_lines, CASE WHEN n_new >= n_old THEN '+' || (n_new - n_old) ELSE '-' || (n_old - n_new) END AS stat FROM
(SELECT doc_id, len(string_split(text, chr(10))) AS n_old, len(list_distinct(string_split(text, chr(10)))) AS n_new FROM documents)""")
def line_diff_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18 (stat): net change of line counts, here by dropping repeated lines."""
    s = T.lines(F.col("text"))
    net = (F.size(F.array_distinct(s)) - F.size(s)).cast("long")
    return load(spark, sf_dir, "documents").select("doc_id", net.alias("net_lines"), F.concat(F.when(net >= 0, "+").otherwise("-"), F.abs(net).cast("string")).alias("stat"))


@query(f"SELECT doc_id, CAST(length(text) + len(regexp_extract_all(text, '{WIDE_SQL}')) AS BIGINT) AS width FROM documents")
def display_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20."""
    return load(spark, sf_dir, "documents").select("doc_id", T.display_width(F.col("text")).alias("width"))


SEQUENCE_WORDS = ("then", "after", "next", "finally", "first")
TASKS_SQL = f"""SELECT doc_id, CASE WHEN numbered >= 2 THEN numbered WHEN bullets >= 2 THEN bullets WHEN parts >= 3 AND {any_hit('lower(text)', SEQUENCE_WORDS)} THEN parts ELSE 0 END AS n_tasks,
CASE WHEN numbered >= 2 THEN 'numbered' WHEN bullets >= 2 THEN 'bullets' WHEN parts >= 3 AND {any_hit('lower(text)', SEQUENCE_WORDS)} THEN 'commas' ELSE 'none' END AS kind FROM"""


@query(TASKS_SQL + r""" (SELECT doc_id, text, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*\d+[.)]\s+\S'))) AS BIGINT) AS numbered,
CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*[-*]\s+\S'))) AS BIGINT) AS bullets, CAST(len(list_filter(string_split(text, ','), lambda x: trim(x) <> '')) AS BIGINT) AS parts FROM documents)""")
def detect_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """numbered lines, else bullets, else comma parts with a word of sequence."""
    s = T.lines(F.col("text"))
    count = lambda xs, p: F.size(F.filter(xs, lambda x: x.rlike(p))).cast("long")
    load(spark, sf_dir, "documents").select("doc_id", "text", count(s, r"^\s*\d+[.)]\s+\S").alias("numbered"), count(s, r"^\s*[-*]\s+\S").alias("bullets"), F.size(F.filter(F.split("text", ",", -1), lambda x: F.trim(x) != "")).cast("long").alias("parts")).createOrReplaceTempView("gneiss_tasks")
    return spark.sql(TASKS_SQL + " gneiss_tasks")


@query("""SELECT id, regexp_extract(t, '(\\w+(?:Error|Exception)): (.*)', 1) AS error_type, regexp_extract(t, '(\\w+(?:Error|Exception)): (.*)', 2) AS message, CAST(len(regexp_extract_all(t, 'File "([^"]+)", line (\\d+)')) AS BIGINT) AS n_frames FROM
(SELECT page_id AS id, 'Traceback (most recent call last):' || chr(10) || '  File "' || url || '", line ' || page_id || chr(10) || 'ValueError: bad page ' || page_id AS t FROM pages)""")
def parse_traceback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, message and frames of tracebacks, here made of pages."""
    t = F.concat(F.lit('Traceback (most recent call last):\n  File "'), "url", F.lit('", line '), F.col("page_id").cast("string"), F.lit("\nValueError: bad page "), F.col("page_id").cast("string"))
    error = r"(\w+(?:Error|Exception)): (.*)"
    return load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_extract(t, error, 1).alias("error_type"), F.regexp_extract(t, error, 2).alias("message"), F.regexp_count(t, F.lit(r'File "([^"]+)", line (\d+)')).cast("long").alias("n_frames"))


@query("""SELECT user_id, CAST(regexp_extract(t, '(\\d+) passed', 1) AS BIGINT) AS passed, CAST(regexp_extract(t, '(\\d+) failed', 1) AS BIGINT) AS failed, CAST(regexp_extract(t, 'TOTAL.*?(\\d+)%', 1) AS BIGINT) AS coverage FROM
(SELECT user_id, '=== ' || sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) || ' passed, ' || sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) || ' failed in 1s ===' || chr(10) || 'TOTAL 100 7 ' || user_id % 101 || '%' AS t FROM events GROUP BY user_id)""")
def parse_test_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and coverage of test reports, here made of events."""
    bad = F.sum((F.col("event_type") == "error").cast("int"))
    t = F.concat(F.lit("=== "), (F.count("*") - bad).cast("string"), F.lit(" passed, "), bad.cast("string"), F.lit(" failed in 1s ===\nTOTAL 100 7 "), (F.col("user_id") % 101).cast("string"), F.lit("%"))
    rows = load(spark, sf_dir, "events").groupBy("user_id").agg(t.alias("t"))
    number = lambda p: F.regexp_extract("t", p, 1).cast("long")
    return rows.select("user_id", number(r"(\d+) passed").alias("passed"), number(r"(\d+) failed").alias("failed"), number(r"TOTAL.*?(\d+)%").alias("coverage"))


@query("""SELECT dir, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, CASE WHEN sum(size) < 1024 THEN 'B' WHEN sum(size) < 1048576 THEN 'KB' ELSE 'MB' END AS unit FROM
(SELECT regexp_extract(url, '^[a-z]+://[^/]+(/[^/]*)', 1) AS dir, octet_length(encode(html)) AS size FROM pages) GROUP BY dir""")
def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: totals of a tree's first level, with size units; here the tree is that of page paths."""
    rows = load(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^/]*)", 1).alias("dir"), F.octet_length("html").alias("size"))
    total = F.sum("size").cast("long")
    return rows.groupBy("dir").agg(F.count("*").alias("n_files"), total.alias("bytes"), F.when(total < 1024, "B").when(total < 1048576, "KB").otherwise("MB").alias("unit"))


@query("SELECT page_id, name FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages) ORDER BY lower(name), page_id LIMIT 200")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 names, whatever the case."""
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("name")).orderBy(F.lower("name"), "page_id").limit(200)


@query("""SELECT item_id, CASE WHEN starts_with(t, '/grep ') THEN 'grep' WHEN starts_with(t, '/read ') THEN 'read' ELSE 'none' END AS tool, trim(split_part(substring(t, 7), '::', 1)) AS pattern, trim(split_part(substring(t, 7), '::', 2)) AS path FROM
(SELECT item_id, CASE item_id % 3 WHEN 0 THEN '/grep ' WHEN 1 THEN '/read ' ELSE 'hello ' END || text || ' :: ' || item_id AS t FROM benchmark)""")
def shortcut_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F26."""
    t = F.concat(F.when(F.col("item_id") % 3 == 0, "/grep ").when(F.col("item_id") % 3 == 1, "/read ").otherwise("hello "), "text", F.lit(" :: "), F.col("item_id").cast("string"))
    arg = F.substring("t", 7, 1 << 30)
    rows = load(spark, sf_dir, "benchmark").select("item_id", t.alias("t"))
    tool = F.when(F.startswith("t", F.lit("/grep ")), "grep").when(F.startswith("t", F.lit("/read ")), "read").otherwise("none")
    return rows.select("item_id", tool.alias("tool"), F.trim(F.split_part(arg, F.lit("::"), F.lit(1))).alias("pattern"), F.trim(F.split_part(arg, F.lit("::"), F.lit(2))).alias("path"))


@query("""SELECT scope, category, CAST(count(*) AS BIGINT) AS n, string_agg('- ' || replace(text, chr(10), ' ') || ' `' || source || '`', chr(10) ORDER BY doc_id) AS body FROM
(SELECT *, doc_id % 3 AS scope, lang AS category, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id DESC) AS k FROM documents) WHERE k <= 200 GROUP BY scope, category""")
def memory_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope's newest 200 entries, which is all that it keeps, as Markdown by category, in order."""
    item = F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" `"), "source", F.lit("`"))
    rows = load(spark, sf_dir, "documents").withColumn("scope", F.col("doc_id") % 3)
    newest = reduce(DataFrame.unionByName, [rows.where(F.col("scope") == k).orderBy(F.desc("doc_id")).limit(200) for k in range(3)])
    e = newest.select("scope", F.col("lang").alias("category"), F.struct("doc_id", item.alias("item")).alias("e"))
    return e.groupBy("scope", "category").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["item"]), "\n").alias("body"))


@query(f"""WITH l AS (SELECT doc_id, line_no, line, CASE WHEN regexp_matches(line, '^[A-ZÀ-Ý][^ ]*[.,]') THEN line END AS header FROM {LINES_SQL})
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS category FROM l""")
def category_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's running header."""
    header = lambda x: F.when(x.rlike("^[A-ZÀ-Ý][^ ]*[.,]"), x)
    # The places of a text's headers; a line's header is the last of them up to it. All within a row, so nothing is shuffled.
    rows = load(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("l"))
    heads = F.filter(F.transform("l", lambda x, i: F.struct(i.alias("i"), header(x).alias("h"))), lambda s: s.h.isNotNull())
    nexts = F.transform("heads", lambda s, k: F.struct(s.i.alias("i"), s.h.alias("h"), F.coalesce(F.try_element_at("heads", k + 2).i, F.size("l")).alias("end")))
    lead = F.array(F.struct(F.lit(0).alias("i"), F.lit("").alias("h"), F.coalesce(F.try_element_at("heads", F.lit(1)).i, F.size("l")).alias("end")))
    runs = rows.withColumn("heads", heads).select("doc_id", F.explode(F.concat(lead, nexts)).alias("s")).where("s.end > s.i")
    return runs.select("doc_id", F.explode(F.sequence(F.col("s.i").cast("long"), F.col("s.end").cast("long") - 1)).alias("line_no"), F.col("s.h").alias("category"))
