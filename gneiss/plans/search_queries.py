"""Queries of ranked retrieval, over documents as memory entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import search as S
from gneiss.plans.base import first_best, hits, load, query

AS_OF = 1_700_000_000.0
TERMS = ("the", "that", "and", "for")
TOK_SQL = r"list_transform(regexp_extract_all({0}, '[a-zA-Z0-9]+|[\x{{4E00}}-\x{{9FFF}}]'), lambda x: lower(x))"
DOC_TOKENS = TOK_SQL.format("text")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("scope"), F.col("lang").alias("category"), F.col("text").alias("content"), F.array("source").alias("tags"), (F.col("doc_id") % 7).alias("usage_count"), (F.lit(AS_OF) - F.col("doc_id") * 3600.0).alias("updated_at"))


@query(f"SELECT term, CAST(count(*) AS BIGINT) AS df, round(ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) + 1)) + 1, 6) AS idf FROM (SELECT DISTINCT doc_id, unnest({DOC_TOKENS}) AS term FROM documents) GROUP BY term")
def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4, G23."""
    docs = load(spark, sf_dir, "documents")
    sets = docs.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    n = docs.agg(F.count("*").alias("_n"))
    return sets.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log((F.col("_n") + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))


def bm25_sql(text: str, terms: tuple[str, ...], rows: str, key: str = "doc_id") -> str:
    lists = "', '".join(terms)
    return f"""t AS (SELECT {key} AS id, {TOK_SQL.format(text)} AS t FROM {rows}), p AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM t),
c AS (SELECT id, dl, term, count(*) AS n FROM p WHERE term IN ('{lists}') GROUP BY ALL), a AS (SELECT avg(len(t)) AS avgdl, count(*) AS docs FROM t),
w AS (SELECT term, ln((any_value(docs) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM c, a GROUP BY term),
bm AS (SELECT id, sum(idf * (n::DOUBLE / dl) * 2.5 / (n::DOUBLE / dl + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM c JOIN w USING (term), a GROUP BY id)"""


@query(f"WITH {bm25_sql('text', TERMS, 'documents')} SELECT id AS doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, id LIMIT 20")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best texts for four terms."""
    found = S.bm25(load(spark, sf_dir, "documents"), "doc_id", F.col("text"), TERMS)
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


EXPANSION_SQL = "CASE x " + " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in S.EXPANSIONS.items()) + " ELSE [] END"


@query("""SELECT item_id, array_to_string(t, ' ') AS expanded FROM (SELECT item_id, list_concat(t, flatten(list_transform(t, lambda x: """ + EXPANSION_SQL + """))) AS t FROM (SELECT item_id, """ + TOK_SQL.format("text") + """ AS t FROM (SELECT item_id, text || ' test config ' || CASE item_id % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'cache' ELSE 'error' END AS text FROM benchmark)))""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: the terms of each query, to which some of the table's are added, and what the table adds to them."""
    table = F.create_map(*[x for k, v in S.EXPANSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    t = T.tokens(F.concat("text", F.lit(" test config "), F.element_at(F.array(F.lit("function"), F.lit("cache"), F.lit("error")), (F.col("item_id") % 3 + 1).cast("int"))))
    more = F.flatten(F.transform("t", lambda x: F.coalesce(F.try_element_at(table, x), F.array().cast("array<string>"))))
    return load(spark, sf_dir, "benchmark").select("item_id", t.alias("t")).select("item_id", F.array_join(F.concat("t", more), " ").alias("expanded"))


SEARCH = "the and"
ENTRY_SQL = f"(SELECT doc_id, doc_id % 3 AS scope, lang AS category, text AS content, source, doc_id % 7 AS usage_count FROM documents)"
MEMORY_SQL = f"""WITH e AS {ENTRY_SQL}, {bm25_sql("content || ' ' || category || ' ' || source", ('the', 'and'), 'e')},
m AS (SELECT e.*, coalesce(score, 0) + CASE WHEN contains(lower(content), 'the and') THEN 2.0::DOUBLE WHEN contains(lower(content), 'the') OR contains(lower(content), 'and') THEN 1.0::DOUBLE ELSE 0::DOUBLE END AS match FROM e LEFT JOIN bm ON e.doc_id = bm.id),
r AS (SELECT *, match + ln(1 + usage_count) * 0.3::DOUBLE + 0.5::DOUBLE / (1.0::DOUBLE + doc_id * 3600.0::DOUBLE / 3600.0 / 24.0) AS total FROM m WHERE match > 0)"""


@query(MEMORY_SQL + " SELECT doc_id, scope, round(total, 5) AS total FROM r ORDER BY round(total, 5) DESC, doc_id LIMIT 50")
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 with boosts, use and age, at a fixed time."""
    found = S.memory_search(entries(spark, sf_dir), SEARCH, AS_OF)
    return found.select(F.col("id").alias("doc_id"), "scope", F.round("total", 5).alias("total")).orderBy(F.desc("total"), "doc_id").limit(50)


@query(MEMORY_SQL + """, k AS (SELECT *, lower(trim(left(content, 100))) AS key, round(total, 5) AS t FROM r), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY scope, t DESC, doc_id) AS n FROM k)
SELECT doc_id, scope, t AS total FROM f WHERE n = 1 ORDER BY scope, t DESC, doc_id LIMIT 20""")
def search_dedup_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope after scope, the first of equal beginnings; not ranked across scopes."""
    found = S.memory_search(entries(spark, sf_dir), SEARCH, AS_OF).select(F.col("id").alias("doc_id"), "scope", F.round("total", 5).alias("total"), F.lower(F.trim(F.left("content", F.lit(100)))).alias("key"))
    first = found.groupBy("key").agg(F.min(F.struct("scope", (-F.col("total")).alias("neg"), "doc_id")).alias("f"))  # combined before the shuffle, unlike row_number
    return first.select("f.doc_id", "f.scope", (-F.col("f.neg")).alias("total")).orderBy("scope", F.desc("total"), "doc_id").limit(20)


@query(f"""WITH p AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS i, len(t) AS dl FROM (SELECT doc_id, {DOC_TOKENS} AS t FROM documents)),
c AS (SELECT doc_id, term, min(i) AS i, round(count(*)::DOUBLE / any_value(dl), 6) AS tf FROM p GROUP BY ALL)
SELECT doc_id, term, tf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, i) AS k FROM c) WHERE k <= 3""")
def keyword_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's three most frequent terms, the first seen of equals."""
    return S.top_terms(load(spark, sf_dir, "documents"), "doc_id", F.col("text"), 3)


#: Keywords by category, in order of precedence.
RULES = {
    "architecture": ("architecture", "design", "pattern", "api", "rest", "backend", "service", "架构", "设计", "模式"),
    "code-pattern": ("function", "method", "def", "class", "函数", "方法", "类"),
    "testing": ("test", "assert", "pytest", "unit", "测试", "断言"),
    "configuration": ("config", "settings", "env", "配置", "设置", "环境"),
    "workflow": ("git", "commit", "branch", "merge", "工作流", "分支", "合并"),
    "security": ("security", "auth", "permission", "安全", "认证", "权限"),
    "performance": ("performance", "optimization", "benchmark", "性能", "优化", "基准"),
    "convention": ("convention", "style", "naming", "规范", "风格", "命名"),
}
CLASS_SQL = first_best({k: hits("low", v) for k, v in RULES.items()}, "general")


@query(f"SELECT doc_id, {CLASS_SQL} AS category FROM (SELECT doc_id, lower(text) AS low FROM documents)")
def auto_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category with most keywords, the first of equals."""
    return load(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low")).select("doc_id", F.expr(CLASS_SQL).alias("category"))


@query("SELECT min(doc_id) AS keep, CAST(count(*) AS BIGINT) AS n, CAST(sum(doc_id % 7) AS BIGINT) AS usage, array_to_string(list_sort(list_distinct(list(source))), ',') AS tags FROM documents GROUP BY lower(trim(text)) HAVING count(*) > 1")
def exact_dup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts become one, with the sum of their uses and the union of their tags."""
    return load(spark, sf_dir, "documents").groupBy(F.sha2(F.lower(F.trim("text")), 256).alias("k")).agg(F.min("doc_id").alias("keep"), F.count("*").alias("n"), F.sum(F.col("doc_id") % 7).alias("usage"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("tags")).where("n > 1").drop("k")


@query("""SELECT doc_id, problem FROM (SELECT doc_id, 'empty content' AS problem FROM documents WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT doc_id, 'empty category' FROM documents WHERE coalesce(lang, '') = ''
UNION ALL SELECT doc_id, 'duplicate id' FROM documents GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT doc_id, 'short content' FROM documents WHERE length(text) < 20)""")
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every violation; those of single rows in one pass."""
    d = load(spark, sf_dir, "documents")
    found = F.array_compact(F.array(F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.lit("empty content")), F.when(F.coalesce("lang", F.lit("")) == "", F.lit("empty category")), F.when(F.length("text") < 20, F.lit("short content"))))
    return d.select("doc_id", F.explode(found).alias("problem")).unionByName(d.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit("duplicate id").alias("problem")))


@query(f"""WITH s AS (SELECT min(doc_id) AS id, t FROM (SELECT doc_id, list_sort(list_distinct({DOC_TOKENS})) AS t FROM documents) WHERE len(t) > 0 GROUP BY t),
x AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) AS c, len(a.t) AS na, len(b.t) AS nb FROM s a JOIN s b ON a.id < b.id AND len(a.t) >= 0.8 * len(b.t) AND len(b.t) >= 0.8 * len(a.t))
SELECT a, b, round(c::DOUBLE / (na + nb - c), 6) AS similarity FROM x WHERE c::DOUBLE / (na + nb - c) >= 0.8""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal token sets, between classes of equal ones."""
    return S.jaccard_pairs(load(spark, sf_dir, "documents"), "doc_id", F.col("text")).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("""WITH s AS (SELECT doc_id, least(1.0, 0.5 + CASE WHEN lang IN ('en', 'de') THEN 0.2 ELSE 0 END + CASE WHEN contains(text, 'that') THEN 0.15 ELSE 0 END + CASE WHEN doc_id < 24 THEN 0.1 WHEN doc_id < 168 THEN 0.05 ELSE 0 END) AS rel, lower(trim(left(text, 100))) AS k FROM documents),
t AS (SELECT * FROM s ORDER BY rel DESC, doc_id LIMIT 5), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rel DESC, doc_id) AS n FROM t) SELECT doc_id, CAST(round(rel, 2) AS DOUBLE) AS relevance FROM f WHERE n = 1""")
def task_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base, category, mention and age; the best five, then without repeats."""
    rel = F.least(F.lit(1.0), F.lit(0.5) + F.when(F.col("lang").isin("en", "de"), 0.2).otherwise(0.0) + F.when(F.contains("text", F.lit("that")), 0.15).otherwise(0.0) + F.when(F.col("doc_id") < 24, 0.1).when(F.col("doc_id") < 168, 0.05).otherwise(0.0))
    top = load(spark, sf_dir, "documents").select("doc_id", F.round(rel, 2).alias("relevance"), F.lower(F.trim(F.left("text", F.lit(100)))).alias("k")).orderBy(F.desc("relevance"), "doc_id").limit(5)
    return top.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("relevance"), "doc_id"))).where("n = 1").select("doc_id", "relevance")


@query("""SELECT doc_id, CAST(round(0.5 + CASE WHEN contains(low, 'error') THEN 0.2 ELSE 0 END + CASE WHEN contains(low, 'license') THEN 0.15 ELSE 0 END, 2) AS DOUBLE) AS relevance FROM (SELECT doc_id, lower(text) AS low FROM documents) ORDER BY 2 DESC, doc_id LIMIT 3""")
def failure_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries for a failed tool and its error."""
    low = F.lower("text")
    rel = F.lit(0.5) + F.when(F.contains(low, F.lit("error")), 0.2).otherwise(0.0) + F.when(F.contains(low, F.lit("license")), 0.15).otherwise(0.0)
    return load(spark, sf_dir, "documents").select("doc_id", F.round(rel, 2).alias("relevance")).orderBy(F.desc("relevance"), "doc_id").limit(3)


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list_distinct(list(source))), ',') AS tags FROM documents WHERE source IN ('src0', 'src3', 'src5') GROUP BY lang")
def tags_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a tag, and the tags of each category."""
    e = entries(spark, sf_dir).where(F.arrays_overlap("tags", F.array(*map(F.lit, ("src0", "src3", "src5")))))
    return e.groupBy(F.col("category").alias("lang")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))), ",").alias("tags"))


@query("SELECT scope, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(content)) AS BIGINT) AS size, CAST(count(DISTINCT category) AS BIGINT) AS categories FROM (SELECT doc_id % 3 AS scope, text AS content, lang AS category FROM documents) GROUP BY scope")
def memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in characters."""
    return entries(spark, sf_dir).groupBy("scope").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("size"), F.countDistinct("category").alias("categories"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, CAST(len(list_distinct(t)) AS BIGINT) AS different, coalesce(t[1], '') AS first FROM (SELECT doc_id, list_concat({DOC_TOKENS}, regexp_extract_all(text, '[\\x{{4E00}}-\\x{{9FFF}}]{{2}}')) AS t FROM documents)")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each text: Latin runs and single CJK characters, then CJK pairs."""
    t = T.tokens(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("different"), F.coalesce(F.get(t, 0), F.lit("")).alias("first"))


@query(MEMORY_SQL + """, s AS (SELECT r.doc_id, r.scope, sum(2.5::DOUBLE * (c.n::DOUBLE / c.dl) / (c.n::DOUBLE / c.dl + 1.5)) AS alone FROM r JOIN c ON c.id = r.doc_id WHERE c.term IN ('the', 'and') GROUP BY ALL)
SELECT doc_id, round(alone / (SELECT max(alone) FROM s), 5) AS relevance FROM s WHERE round(alone / (SELECT max(alone) FROM s), 5) >= 0.5""")
def min_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found entries whose score by themselves is at least half the best; alone, each term has weight 1 and an average length."""
    found = S.memory_search(entries(spark, sf_dir), SEARCH, AS_OF).select("id", "content", "category", "tags")
    terms = ("the", "and")
    rows = S.counted(found, F.concat_ws(" ", "content", "category", F.array_join("tags", " ")), terms)
    tf = [F.col(f"_c{k}") / F.col("_dl") for k in range(len(terms))]
    alone = rows.select("id", sum((S.K1 + 1) * x / (x + S.K1) for x in tf).alias("alone")).where("alone > 0")
    best = F.broadcast(alone.agg(F.max("alone").alias("best")))  # one row
    return alone.crossJoin(best).select(F.col("id").alias("doc_id"), F.round(F.col("alone") / F.col("best"), 5).alias("relevance")).where("relevance >= 0.5")


@query()
def greedy_dup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal entries merged greedily in order of id, those with equal token sets among them."""
    return S.duplicate_merge(load(spark, sf_dir, "documents"), "doc_id", F.col("text"))
