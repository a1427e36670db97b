"""Queries that need Python's own parsers, over source made of the rows of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import source_code as C
from gneiss.plans.base import load, query, spread

TEMPLATE = 'import os\nimport sys\n\n\nclass Page{0}(Base):\n    """Page {0}."""\n\n    @cached\n    def size(self, unit):\n        return len(sys.argv) + {0}\n\n\ndef main():\n    return Page{0}\n'


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.lit(p) for p in TEMPLATE.split("{0}")]
    k = F.col("page_id").cast("string")
    source = F.concat(parts[0], *[x for p in parts[1:] for x in (k, p)])
    return load(spark, sf_dir, "pages").select(F.concat(F.lit("p"), k, F.lit(".py")).alias("file"), source.alias("source"))


@query("""SELECT 'p' || page_id || '.py' AS file, s.type, CASE WHEN s.name = 'Page' THEN 'Page' || page_id ELSE s.name END AS name, CAST(s.line AS BIGINT) AS line, s.args, CASE WHEN s.name = 'Page' THEN 'Page ' || page_id || '.' END AS docstring
FROM pages, (VALUES ('class', 'Page', 5, ''), ('function', 'size', 9, 'self,unit'), ('function', 'main', 13, '')) s(type, name, line, args)""")
def ast_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F28."""
    return C.symbols(files(spark, sf_dir)).select("file", "type", "name", "line", F.array_join("args", ",").alias("args"), "docstring")


@query("""SELECT 'p' || page_id || '.py' AS file, CAST(s.line AS BIGINT) AS line, s.severity, replace(s.message, '#', CAST(page_id AS VARCHAR)) AS message FROM pages,
(VALUES (1, 'warning', 'unused import os'), (9, 'info', 'no docstring: size'), (10, 'info', 'magic number #'), (13, 'info', 'no docstring: main')) s(line, severity, message) WHERE s.line <> 10 OR page_id > 100""")
def code_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F29, O5, Q17."""
    return C.code_review(files(spark, sf_dir))


@query("SELECT CAST(count(*) AS BIGINT) AS files, CAST(15 * count(*) AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS classes, CAST(2 * count(*) AS BIGINT) AS functions, CAST(2 * count(*) AS BIGINT) AS imports FROM pages")
def ast_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G19."""
    f = files(spark, sf_dir)
    n = f.agg(F.count("*").alias("files"), F.sum(F.size(F.split("source", "\n", -1))).alias("lines"), F.sum(F.regexp_count("source", F.lit(r"(?m)^import "))).cast("long").alias("imports"))
    s = C.symbols(f).agg(F.sum((F.col("type") == "class").cast("long")).alias("classes"), F.sum((F.col("type") == "function").cast("long")).alias("functions"))
    return n.crossJoin(s).select("files", "lines", "classes", "functions", "imports")  # a row each


@query()
def unified_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18."""
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", C.unified_diff(t, F.replace(t, F.lit("Licensed"), F.lit("LICENSED"))).alias("diff")).where("diff <> ''")


@query()
def fuzzy_block_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16, W8."""
    best = C.fuzzy_block(F.col("text"), "Licensed under the Apache Licence, version 2.0.")
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", best.alias("b")).select("doc_id", "b.line", F.round("b.ratio", 6).alias("ratio"))


@query()
def hmac_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8."""
    return load(spark, sf_dir, "documents").select("doc_id", C.hmac_hex(F.col("text"), "key").alias("hmac"))


@query("SELECT page_id, ['git', 'commit', '-m', 'page ' || page_id] AS words FROM pages".replace("['git', 'commit', '-m', 'page ' || page_id]", "'git|commit|-m|page ' || page_id"))
def command_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F27."""
    c = F.concat(F.lit("git commit -m 'page "), F.col("page_id").cast("string"), F.lit("'"))
    return load(spark, sf_dir, "pages").select("page_id", F.array_join(C.command_split(c), "|").alias("words"))


@query("SELECT page_id, CAST(7 AS BIGINT) AS start, CAST(7 + length(CAST(page_id AS VARCHAR)) AS BIGINT) AS old_end, CAST(8 AS BIGINT) AS new_end FROM pages")
def changed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19."""
    k = F.col("page_id").cast("string")
    return load(spark, sf_dir, "pages").select("page_id", C.changed_range(F.concat(F.lit("before "), k, F.lit(" after")), F.lit("before # after")).alias("r")).select("page_id", "r.*")
