"""Queries that score or classify texts by fixed rules. Conditions are SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.plans.base import any_hit, first_best, hits, load, query

#: Words by error category, in order of precedence; strategies.
ERRORS = {
    "network": ("connection", "timeout", "network", "refused", "unreachable", "reset", "closed", "dns", "ssl", "certificate"),
    "permission": ("permission", "access denied", "unauthorized", "forbidden", "privilege", "not allowed", "restricted", "admin"),
    "resource": ("memory", "disk", "space", "resource", "quota", "limit", "exceeded", "out of", "no space", "too large"),
    "timeout": ("timeout", "timed out", "deadline", "expired", "took too long"),
    "logic": ("invalid", "not found", "does not exist", "already exists", "bad request", "syntax", "parse", "format", "type error"),
}
STRATEGY = {"network": "retry_exponential_backoff", "timeout": "wait_and_retry", "permission": "request_permission", "resource": "wait_and_retry", "logic": "fallback_alternative", "unknown": "retry_immediate"}
#: Words by complexity of a task, and of a task's needs.
SIMPLE = ("list", "show", "display", "what is", "explain", "summarize", "format", "convert", "count", "search", "find", "read")
MODERATE = ("create", "write", "implement", "add", "modify", "update", "refactor", "optimize", "test", "debug", "fix", "analyze", "compare", "review", "check", "validate")
COMPLEX = ("architect", "design", "build", "develop", "integrate", "migrate", "deploy", "automate", "orchestrate", "pipeline", "framework", "system", "platform", "infrastructure")
CRITICAL = ("security", "production", "critical", "emergency", "urgent", "data loss", "breach", "vulnerability", "compliance")
CODING = ("code", "function", "class", "python", "javascript", "typescript", "react", "django", "flask", "api", "database", "sql", "html", "css", "implement", "algorithm", "data structure", "bug", "test")
REASONING = ("analyze", "evaluate", "compare", "reason", "explain why", "pros and cons", "trade-offs", "architecture", "design pattern", "best practice", "strategy")
CREATIVE = ("creative", "innovative", "unique", "original", "design", "brainstorm", "generate ideas", "concept", "vision")
DANGEROUS = ("delete", "drop", "destroy", "remove all", "format", "rm -rf", "sudo", "admin", "production", "live")
URGENT = ("urgent", "asap", "immediately", "critical")
#: Words by agent role.
ROLE_WORDS = {
    "research": ("research", "search", "find", "gather", "analyze", "investigate", "study", "explore"),
    "code": ("code", "implement", "write", "develop", "program", "build", "create", "fix bug"),
    "test": ("test", "testing", "verify", "validate", "check", "assert", "coverage"),
    "review": ("review", "audit", "inspect", "check", "evaluate", "assess", "critique"),
    "architect": ("design", "architecture", "structure", "pattern", "system", "framework"),
    "devops": ("deploy", "docker", "ci/cd", "pipeline", "infrastructure", "host", "server"),
    "document": ("document", "readme", "doc", "explain", "describe", "guide", "tutorial"),
}
#: Patterns of prompt injection, of unsafe output and of commands that are always blocked.
INJECTION = r"ignore\s+(all\s+)?(previous|prior)\s+(instructions|rules|prompts)|(system|developer)\s*:\s*|\[?ignore\s+security\]?|(bypass|skip|override)\s+(permissions|safety|restrictions)|(execute|run)\s+(this|following)\s+code\s*:|ignore\s+(all|your)\s+instructions"
UNSAFE = r"rm\s+-rf|sudo\s+|chmod\s+777|del\s+/[sfq]|rmdir\s+/s|rd\s+/s|format\s+[a-zA-Z]:|DROP\s+TABLE|DELETE\s+FROM.*WHERE\s+1\s*=\s*1"
BLOCKED = r"rm\s+-rf\s+/|chmod\s+777|curl.*\|\s*sh|wget.*\|\s*sh|mkfs|dd\s+if=|rmdir\s+/s\s+/q|rd\s+/s\s+/q|format\s+[a-zA-Z]:|iwr.*\|\s*iex|reg\s+delete\s+HKLM"
HIGH_RISK = ("rm -rf", "rm -r", "git reset --hard", "git clean", "git push --force", "sudo", "chmod -r", "chown -r", "format")
#: Patterns of overload and of network errors.
OVERLOAD = r"overloaded|overload|capacity|too many requests|temporarily unavailable|please try again later|service is currently unavailable|api is temporarily|high demand"
NETWORK = r"connection\s*(refused|reset|timeout|aborted)|timed?\s*out|dns\s*resolution|name\s*resolution|network\s*(error|unreachable|down)|socket\s*(error|closed)|eof\s*occurred|ssl\s*error|certificate\s*verify|handshake\s*failed"


def low(table: str, key: str) -> str:
    return f"(SELECT {key}, text, lower(text) AS low FROM {table})"


def texts(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id") -> DataFrame:
    return load(spark, sf_dir, table).select(key, "text", F.lower("text").alias("low"))


ERROR_TOP = "greatest(" + ", ".join(hits("low", v) for v in ERRORS.values()) + ")"
ERROR_CLASS = first_best({k: hits("low", v) for k, v in ERRORS.items()}, "unknown")
ERROR_CONF = f"CAST(CASE WHEN {ERROR_TOP} > 0 THEN least(0.95, 0.5 + {ERROR_TOP} * 0.15) ELSE 0.3 END AS DOUBLE)"
STRATEGY_CASE = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STRATEGY.items()) + " END"


@query(f"SELECT doc_id, category, confidence, CASE WHEN doc_id % 2 = 0 AND category = 'logic' THEN 'skip_and_continue' ELSE {STRATEGY_CASE} END AS strategy FROM (SELECT doc_id, {ERROR_CLASS} AS category, {ERROR_CONF} AS confidence FROM {low('documents', 'doc_id')})")
def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, Q20; the tool of even ids is a reading one."""
    rows = texts(spark, sf_dir).select("doc_id", F.expr(ERROR_CLASS).alias("category"), F.expr(ERROR_CONF).alias("confidence"))
    return rows.withColumn("strategy", F.when((F.col("doc_id") % 2 == 0) & (F.col("category") == "logic"), "skip_and_continue").otherwise(F.expr(STRATEGY_CASE)))


METRIC_CLASS = f"CASE WHEN {any_hit('low', ERRORS['network'][:5])} THEN 'network' WHEN {any_hit('low', ERRORS['permission'][:4])} THEN 'permission' WHEN {any_hit('low', ERRORS['resource'][:5])} THEN 'resource' WHEN low <> '' THEN 'logic' ELSE 'unknown' END"


@query(f"SELECT category, CAST(count(*) AS BIGINT) AS n FROM (SELECT {METRIC_CLASS} AS category FROM {low('documents', 'doc_id')}) GROUP BY category")
def metric_error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: the first category with a word, and their counts."""
    return texts(spark, sf_dir).groupBy(F.expr(METRIC_CLASS).alias("category")).agg(F.count("*").alias("n"))


API_CLASS = "CASE WHEN status = 429 THEN 'rate_limit' WHEN status = 529 THEN 'overload' WHEN status IN (401, 403) THEN 'auth_error' WHEN status IN (400, 404, 405, 409, 413, 415, 422) THEN 'input_error' WHEN status IN (500, 502, 503, 504) THEN CASE WHEN {o} THEN 'overload' ELSE 'server_error' END WHEN {n} THEN 'network_error' WHEN {o} THEN 'overload' ELSE 'unknown' END"
STATUS = "CASE doc_id % 8 WHEN 0 THEN 429 WHEN 1 THEN 529 WHEN 2 THEN 401 WHEN 3 THEN 404 WHEN 4 THEN 500 WHEN 5 THEN 503 ELSE NULL END"


def _matches(p: str, duck: bool) -> str:
    p = p.replace("'", "''")
    return f"regexp_matches(text, '(?i){p}')" if duck else "text RLIKE '(?i)" + p.replace("\\", "\\\\") + "'"


@query(f"SELECT doc_id, category, category IN ('rate_limit', 'server_error', 'network_error', 'overload', 'unknown') AS retryable FROM (SELECT doc_id, {API_CLASS.format(o=_matches(OVERLOAD, True), n=_matches(NETWORK, True))} AS category FROM (SELECT doc_id, text, {STATUS} AS status FROM documents))")
def api_error_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4."""
    rows = texts(spark, sf_dir).withColumn("status", F.expr(STATUS)).select("doc_id", F.expr(API_CLASS.format(o=_matches(OVERLOAD, False), n=_matches(NETWORK, False))).alias("category"))
    return rows.withColumn("retryable", F.col("category").isin("rate_limit", "server_error", "network_error", "overload", "unknown"))


#: Factors of the wait by category.
BACKOFF = {"rate_limit": 2.0, "server_error": 1.0, "network_error": 0.5, "overload": 3.0, "unknown": 1.0}
BACKOFF_ROWS = ", ".join(f"('{k}', {v})" for k, v in BACKOFF.items())


@query(f"""SELECT category, attempt, CAST(greatest(0.1, least(0.5 * f * pow(2, attempt), 8.0)) AS DOUBLE) AS wait, CAST(greatest(least(5.0, 8.0), 0.5 * f * pow(2, least(attempt, 2))) AS DOUBLE) AS wait_after_header
FROM (VALUES {BACKOFF_ROWS}) c(category, f), (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS attempt)""")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F25, without jitter: by category and attempt, also after a header that asks for 5 seconds."""
    rows = spark.createDataFrame(list(BACKOFF.items()), "category string, f double").select("category", "f", F.explode(F.array(*map(F.lit, range(6)))).alias("attempt"))
    base = F.lit(0.5) * F.col("f")
    return rows.select("category", "attempt", F.greatest(F.lit(0.1), F.least(base * F.pow(F.lit(2.0), "attempt"), F.lit(8.0))).alias("wait"), F.greatest(F.lit(5.0), base * F.pow(F.lit(2.0), F.least("attempt", F.lit(2)))).alias("wait_after_header"))


COMPLEXITY_SCORE = f"({hits('low', COMPLEX)} * 3.0 + {hits('low', MODERATE)} * 1.5 + {hits('low', SIMPLE)} * 0.5 + least(length(text) / 500.0, 1.0) * 2)"
#: The score is computed once: each limit that it reaches counts.
COMPLEXITY = f"CASE WHEN {any_hit('low', CRITICAL)} THEN 'critical' ELSE list_extract(['simple', 'moderate', 'complex', 'critical'], CAST(1 + least(3, floor(coalesce({COMPLEXITY_SCORE}, 0) / 2.0)) AS INT)) END"
SPARK_COMPLEXITY = COMPLEXITY.replace("list_extract([", "element_at(array(").replace("'critical'],", "'critical'),")
FLAGS = ", ".join(f"{any_hit('low', w)} AS {n}" for n, w in (("coding", CODING), ("reasoning", REASONING), ("creative", CREATIVE), ("dangerous", DANGEROUS), ("urgent", URGENT)))


@query(f"SELECT doc_id, {COMPLEXITY} AS complexity, CAST(greatest(500, length(text) // 4) AS BIGINT) AS estimated_tokens, {FLAGS} FROM {low('documents', 'doc_id')}")
def task_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, K6."""
    flags = [F.expr(x) for x in (any_hit("low", w) + f" AS {n}" for n, w in (("coding", CODING), ("reasoning", REASONING), ("creative", CREATIVE), ("dangerous", DANGEROUS), ("urgent", URGENT)))]
    return texts(spark, sf_dir).select("doc_id", F.expr(SPARK_COMPLEXITY).alias("complexity"), F.greatest(F.lit(500), F.floor(F.length("text") / 4)).cast("long").alias("estimated_tokens"), *flags)


#: Tiers by complexity: name, prices for a million tokens in and out.
TIERS = {"simple": ("fast", 0.25, 1.25), "moderate": ("balanced", 3.0, 15.0), "complex": ("powerful", 15.0, 75.0), "critical": ("critical", 15.0, 75.0)}
TIER_ROWS = ", ".join(f"('{k}', '{n}', {a}::DOUBLE, {b}::DOUBLE)" for k, (n, a, b) in TIERS.items())


@query(f"SELECT doc_id, tier, round(n / 1000000.0::DOUBLE * i + 2 * n / 1000000.0::DOUBLE * o, 6) AS estimated_cost FROM (SELECT doc_id, {COMPLEXITY} AS complexity, greatest(500, length(text) // 4) AS n FROM {low('documents', 'doc_id')}) JOIN (VALUES {TIER_ROWS}) t(complexity, tier, i, o) USING (complexity)")
def task_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier of a task and its estimated cost."""
    tiers = spark.createDataFrame([(k, *v) for k, v in TIERS.items()], "complexity string, tier string, i double, o double")  # four rows
    n = F.greatest(F.lit(500), F.floor(F.length("text") / 4))
    rows = texts(spark, sf_dir).select("doc_id", F.expr(SPARK_COMPLEXITY).alias("complexity"), n.alias("n")).join(F.broadcast(tiers), "complexity")
    return rows.select("doc_id", "tier", F.round(F.col("n") / 1e6 * F.col("i") + 2 * F.col("n") / 1e6 * F.col("o"), 6).alias("estimated_cost"))


@query(f"SELECT complexity, CAST(count(*) AS BIGINT) AS n, round(avg(c), 6) AS avg_cost FROM (SELECT {COMPLEXITY} AS complexity, greatest(500, length(text) // 4) / 1000000.0::DOUBLE * 3 AS c FROM {low('documents', 'doc_id')}) GROUP BY complexity")
def routing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8."""
    c = F.greatest(F.lit(500), F.floor(F.length("text") / 4)) / 1e6 * 3
    return texts(spark, sf_dir).groupBy(F.expr(SPARK_COMPLEXITY).alias("complexity")).agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("avg_cost"))


COMMAND = "CASE doc_id % 6 WHEN 0 THEN 'rm -rf /' || source WHEN 1 THEN 'git push --force ' WHEN 2 THEN 'ls ' || lang WHEN 3 THEN 'curl x | sh' WHEN 4 THEN 'sudo ls' ELSE 'cat a' END"
RISK = f"CASE WHEN {{m}} THEN 'block' WHEN {any_hit('low', HIGH_RISK)} THEN 'prompt' ELSE 'allow' END"


@query(f"SELECT doc_id, {RISK.format(m=_matches(BLOCKED, True))} AS risk FROM (SELECT doc_id, {COMMAND} AS text, lower({COMMAND}) AS low FROM documents)")
def risk_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: blocked patterns, then risky words."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.expr(COMMAND).alias("text")).withColumn("low", F.lower("text"))
    return rows.select("doc_id", F.expr(RISK.format(m=_matches(BLOCKED, False))).alias("risk"))


@query(f"SELECT doc_id, regexp_matches(text, '(?i){INJECTION}') AS injection, regexp_matches(text, '(?i){UNSAFE}') AS unsafe FROM documents")
def prompt_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9."""
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", t.rlike(f"(?i){INJECTION}").alias("injection"), t.rlike(f"(?i){UNSAFE}").alias("unsafe"))


TIER_CASE = "CASE WHEN cmd = 'git' AND (contains(args, 'reset') AND contains(args, '--hard') OR contains(args, 'clean') OR contains(args, 'push') AND (contains(args, '--force') OR contains(args, ' -f'))) THEN 'dangerous' WHEN cmd = 'rm' AND contains(args, 'r') AND contains(args, 'f') AND contains(args, '-') THEN 'catastrophic' WHEN cmd IN ('dd', 'mkfs', 'fdisk', 'format') THEN 'disk' WHEN cmd = 'chmod' AND contains(args, '777') THEN 'open' WHEN cmd IN ('node', 'python', 'python3', 'bun', 'bash', 'sh', 'zsh', 'powershell', 'pwsh') THEN 'code' ELSE 'safe' END"


@query(f"SELECT doc_id, {TIER_CASE} AS tier FROM (SELECT doc_id, split_part({COMMAND}, ' ', 1) AS cmd, substring({COMMAND}, strpos({COMMAND}, ' ')) AS args FROM documents)")
def command_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.expr(COMMAND).alias("c"))
    return rows.select("doc_id", F.split_part("c", F.lit(" "), F.lit(1)).alias("cmd"), F.expr("substring(c, instr(c, ' '))").alias("args")).select("doc_id", F.expr(TIER_CASE).alias("tier"))


ROLE_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{r}' AS role, {n} AS pos, {hits('low', w)} AS score FROM {low('documents', 'doc_id')}" for n, (r, w) in enumerate(ROLE_WORDS.items()))


@query(f"WITH s AS ({ROLE_ROWS}), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS n FROM s WHERE score > 0) SELECT d.doc_id, coalesce(string_agg(role, ',' ORDER BY n), 'research,code') AS roles FROM documents d LEFT JOIN (SELECT * FROM k WHERE n <= 3) k ON d.doc_id = k.doc_id GROUP BY d.doc_id")
def role_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three roles with most words, or the usual two; sorted within each row's array, so without a shuffle."""
    scores = F.array(*[F.struct((-F.expr(hits("low", w))).alias("s"), F.lit(n).alias("pos"), F.lit(r).alias("role")) for n, (r, w) in enumerate(ROLE_WORDS.items())])
    top = F.transform(F.slice(F.array_sort(F.filter(scores, lambda x: x["s"] < 0)), 1, 3), lambda x: x["role"])
    return texts(spark, sf_dir).select("doc_id", F.when(F.size(top) > 0, F.array_join(top, ",")).otherwise("research,code").alias("roles"))


AGENT = f"CASE WHEN {any_hit('low', ('explore', 'find', 'search'))} THEN 'explore' WHEN {any_hit('low', ('plan', 'design'))} THEN 'plan' WHEN length(text) > 4000 THEN 'explore' ELSE 'general' END"


@query(f"SELECT doc_id, {AGENT} AS agent FROM {low('documents', 'doc_id')}")
def subagent_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K11."""
    return texts(spark, sf_dir).select("doc_id", F.expr(AGENT).alias("agent"))


PROVIDER = "CASE WHEN contains(m, 'claude') THEN 'anthropic' WHEN starts_with(m, 'gpt') OR starts_with(m, 'o1') THEN 'openai' WHEN contains(m, '/') THEN split_part(m, '/', 1) ELSE 'unknown' END"
MODEL_NAME = "CASE n_nationkey % 4 WHEN 0 THEN 'claude-' || n_nationkey WHEN 1 THEN 'gpt-' || n_nationkey WHEN 2 THEN 'acme/m' || n_nationkey ELSE lower(n_name) END"


@query(f"SELECT k, m, {PROVIDER} AS provider FROM (SELECT n_nationkey AS k, {MODEL_NAME} AS m FROM nation)")
def model_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers by name."""
    rows = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.expr(MODEL_NAME).alias("m"))
    return rows.select("k", "m", F.expr(PROVIDER.replace("starts_with", "startswith")).alias("provider"))


SUCCESS = "sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)"
NUDGE = f"CASE WHEN {SUCCESS} = 0 THEN 'try another way' WHEN count(*) - {SUCCESS} > {SUCCESS} THEN 'slow down' ELSE 'go on' END"


@query(f"SELECT user_id, {NUDGE} AS nudge FROM events GROUP BY user_id")
def progress_nudge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2."""
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.expr(NUDGE).alias("nudge"))


@query("""SELECT user_id, CAST(row_number() OVER (ORDER BY rate DESC, user_id) AS BIGINT) AS place, CASE WHEN rate >= 0.9 THEN 8 WHEN rate >= 0.7 THEN 4 ELSE 3 END AS workers FROM (SELECT user_id, round(avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM events GROUP BY user_id)""")
def tool_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tool's place by success rate, and workers. The schedule of calls is ``tool_call_schedule``.

    Rates have six places, so there are at most a million: places are counted by rate first, then within each rate.
    """
    from pyspark.sql import Window

    tools = load(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg((F.col("event_type") != "error").cast("double")), 6).alias("rate"))
    better = Window.orderBy(F.desc("rate")).rowsBetween(Window.unboundedPreceding, -1)  # of rates, not of tools
    rates = tools.groupBy("rate").agg(F.count("*").alias("n")).select("rate", F.coalesce(F.sum("n").over(better), F.lit(0)).alias("ahead"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("rate").orderBy("user_id"))
    return tools.join(rates, "rate").select("user_id", place.alias("place"), F.when(F.col("rate") >= 0.9, 8).when(F.col("rate") >= 0.7, 4).otherwise(3).alias("workers"))


@query()
def tool_call_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of every turn by its tool's success rate, concurrent or serial, and the turn's workers.

    A turn is ten consecutive events, a tool a user. Tools that failed in the same turn had a conflict.
    """
    from gneiss.operators import scheduling

    e = load(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).alias("turn"), F.col("event_id").alias("call"), F.col("user_id").alias("tool"), (F.col("event_type") != "error").alias("ok"))
    k = F.col("tool")
    tools = e.groupBy("tool").agg((F.sum(F.col("ok").cast("long")) / F.count("*")).alias("rate")).select("tool", "rate", (k % 5 != 0).alias("safe"), (k % 11 == 1).alias("writes"), (k % 13 == 1).alias("runs"))
    bad = e.where(~F.col("ok"))
    both = bad.alias("x").join(bad.alias("y"), (F.col("x.turn") == F.col("y.turn")) & (F.col("x.call") < F.col("y.call")))
    conflicts = both.select(F.least("x.tool", "y.tool").alias("a"), F.greatest("x.tool", "y.tool").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    return scheduling.schedule(e.select("turn", "call", "tool"), tools, conflicts)


@query("""SELECT severity, doc_id FROM (SELECT doc_id, severity, row_number() OVER (PARTITION BY severity ORDER BY doc_id) AS n FROM (SELECT doc_id, CASE WHEN n_chars > 8000 THEN 'warning' WHEN n_chars < 200 THEN 'info' ELSE 'style' END AS severity FROM documents)) WHERE n <= 10""")
def issues_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten issues of each class; each task keeps ten before the shuffle."""
    s = F.when(F.col("n_chars") > 8000, "warning").when(F.col("n_chars") < 200, "info").otherwise("style")
    rows = load(spark, sf_dir, "documents").select(s.alias("severity"), "doc_id")
    first = [rows.where(F.col("severity") == c).orderBy("doc_id").limit(10) for c in ("warning", "info", "style")]
    return first[0].unionByName(first[1]).unionByName(first[2])
