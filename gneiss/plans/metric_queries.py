"""Queries over telemetry: cost, success, errors, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.plans.base import load, query

#: USD for a million tokens (input, output), by model, and for any other model.
PRICES = {"click": (0.25, 1.25), "view": (3.0, 15.0), "error": (15.0, 75.0)}
DEFAULT_PRICE = (3.0, 15.0)
PRICE_SQL = ", ".join(f"('{m}', {a}, {b})" for m, (a, b) in PRICES.items())
USE_SQL = "(SELECT *, CAST(coalesce(json_extract_string(props, '$.k'), '0') AS BIGINT) AS k FROM events)"
PRICED_SQL = f"(SELECT e.*, k / 1000000.0::DOUBLE * coalesce(p.i, {DEFAULT_PRICE[0]})::DOUBLE + 2 * k / 1000000.0::DOUBLE * coalesce(p.o, {DEFAULT_PRICE[1]})::DOUBLE AS cost FROM {USE_SQL} e LEFT JOIN (VALUES {PRICE_SQL}) p(model, i, o) ON e.event_type = p.model)"


def bad() -> Column:
    return F.col("event_type") == "error"



def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: tokens are props.k in and twice that out, the model and the tool are the type."""
    return load(spark, sf_dir, "events").withColumn("k", F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")).cast("long"))


def priced(calls: DataFrame) -> DataFrame:
    """Calls with their cost; the price list is a literal map, so there is no join."""
    pair = lambda n: F.coalesce(F.try_element_at(F.create_map(*[x for m, p in PRICES.items() for x in (F.lit(m), F.lit(p[n]))]), F.col("event_type")), F.lit(DEFAULT_PRICE[n]))
    return calls.withColumn("cost", F.col("k") / F.lit(1e6) * pair(0) + 2 * F.col("k") / F.lit(1e6) * pair(1))


@query(f"SELECT event_type AS model, CAST(count(*) AS BIGINT) AS calls, CAST(sum(k) AS BIGINT) AS input_tokens, CAST(sum(2 * k) AS BIGINT) AS output_tokens, round(sum(cost), 6) AS cost_usd, round(sum(value), 4) AS duration_ms FROM {PRICED_SQL} GROUP BY event_type")
def cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, J1."""
    return priced(usage(spark, sf_dir)).groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.sum("k").alias("input_tokens"), F.sum(2 * F.col("k")).alias("output_tokens"), F.round(F.sum("cost"), 6).alias("cost_usd"), F.round(F.sum("value"), 4).alias("duration_ms"))


@query(f"SELECT coalesce(event_type, 'total') AS model, CAST(count(*) AS BIGINT) AS calls, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, round(sum(cost), 6) AS cost_usd, round(avg(value), 4) AS avg_ms FROM {PRICED_SQL} GROUP BY ROLLUP (event_type)")
def cost_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By model and in all."""
    return priced(usage(spark, sf_dir)).rollup("event_type").agg(F.count("*").alias("calls"), F.sum(bad().cast("long")).alias("errors"), F.round(F.sum("cost"), 6).alias("cost_usd"), F.round(F.avg("value"), 4).alias("avg_ms")).select(F.coalesce("event_type", F.lit("total")).alias("model"), "calls", "errors", "cost_usd", "avg_ms")


@query(f"SELECT round(sum(cost), 6) AS cost_usd, round(sum(cost) / greatest(1, date_diff('second', min(ts), max(ts)) / 60.0::DOUBLE), 8) AS cost_per_minute FROM {PRICED_SQL}")
def cost_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost for each minute, of which there is at least one."""
    minutes = F.expr("timestampdiff(SECOND, min(date_trunc('SECOND', ts)), max(date_trunc('SECOND', ts))) / 60.0D")
    return priced(usage(spark, sf_dir)).agg(F.round(F.sum("cost"), 6).alias("cost_usd"), F.round(F.sum("cost") / F.greatest(F.lit(1.0), minutes), 8).alias("cost_per_minute"))


@query("""SELECT user_id AS tool, CAST(count(*) AS BIGINT) AS executions, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS successes, round(avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0 END), 6) AS success_rate, round(avg(value), 4) AS avg_duration FROM events GROUP BY user_id""")
def tool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4."""
    ok = (~bad()).cast("long")
    return load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("tool")).agg(F.count("*").alias("executions"), F.sum(ok).alias("successes"), F.round(F.avg(ok), 6).alias("success_rate"), F.round(F.avg("value"), 4).alias("avg_duration"))


@query("""SELECT user_id, array_to_string(list_sort(list(event_type || '=' || n)), ',') AS mix FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def tool_error_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind as a map, in order."""
    n = load(spark, sf_dir, "events").groupBy("user_id", "event_type").count()
    return n.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("event_type", F.lit("="), F.col("count").cast("string")))), ",").alias("mix"))


@query("""SELECT turn_id, tools, success_rate, duration FROM (SELECT event_id // 20 AS turn_id, CAST(count(*) AS BIGINT) AS tools, round(avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0 END), 6) AS success_rate, round(sum(value), 4) AS duration FROM events GROUP BY 1) ORDER BY turn_id DESC LIMIT 50""")
def turn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 turns of 20 calls."""
    return load(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 20).alias("turn_id")).agg(F.count("*").alias("tools"), F.round(F.avg((~bad()).cast("long")), 6).alias("success_rate"), F.round(F.sum("value"), 4).alias("duration")).orderBy(F.desc("turn_id")).limit(50)


@query("SELECT event_type AS hook, CAST(count(*) AS BIGINT) AS calls, round(sum(value), 4) AS total_ms FROM events GROUP BY event_type")
def hook_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12."""
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("hook")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total_ms"))


@query("SELECT event_type AS tool, CAST(count(*) AS BIGINT) AS uses, CAST(min(event_id) AS BIGINT) AS first_seen FROM events GROUP BY event_type ORDER BY uses DESC, first_seen LIMIT 5")
def tool_usage_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most used first, of equals the first seen."""
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("uses"), F.min("event_id").alias("first_seen")).orderBy(F.desc("uses"), "first_seen").limit(5)


FEEDBACK_SQL = """SELECT d.lang AS model, CAST(count(*) AS BIGINT) AS tasks, round(avg(l.quality::DOUBLE), 3) AS success_rate, round(avg(d.n_chars / 10000.0::DOUBLE), 4) AS avg_cost_usd, CAST(sum(l.toxic) AS BIGINT) AS total_errors,
round(greatest(0, least(1, 0.7 * avg(l.quality::DOUBLE) + 0.3 * (1 - least(avg(d.n_chars / 10000.0::DOUBLE), 1)))), 3) AS score FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    sr, cost = F.avg(F.col("quality").cast("double")), F.avg(F.col("n_chars") / 10000.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * sr + 0.3 * (1 - F.least(cost, F.lit(1.0)))))
    return rows.groupBy(F.col("lang").alias("model")).agg(F.count("*").alias("tasks"), F.round(sr, 3).alias("success_rate"), F.round(cost, 4).alias("avg_cost_usd"), F.sum("toxic").cast("long").alias("total_errors"), F.round(score, 3).alias("score"))


@query(FEEDBACK_SQL)
def model_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9."""
    return feedback(spark, sf_dir)


@query(f"SELECT arg_max(model, score * 1000 - ascii(model) / 1000.0) AS best, max(score) AS score FROM ({FEEDBACK_SQL})")
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest score, of equals the first by name."""
    return feedback(spark, sf_dir).agg(F.max_by("model", F.col("score") * 1000 - F.ascii("model") / 1000.0).alias("best"), F.max("score").alias("score"))


@query("""SELECT trace, CASE WHEN slow > 0 THEN 'add_specialist' WHEN error_rate > 0.3 THEN 'insert_validation' WHEN error_rate > 0 AND error_rate < 1 THEN 'reallocate_tasks' ELSE 'none' END AS action, round(error_rate, 6) AS error_rate, CAST(slow AS BIGINT) AS slow FROM
(SELECT user_id AS trace, avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS error_rate, sum(CASE WHEN value > 480 THEN 1 ELSE 0 END) AS slow FROM events GROUP BY user_id)""")
def workflow_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slow agents, else many errors, else part success."""
    t = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("trace")).agg(F.avg(bad().cast("double")).alias("e"), F.sum((F.col("value") > 480).cast("long")).alias("slow"))
    action = F.when(F.col("slow") > 0, "add_specialist").when(F.col("e") > 0.3, "insert_validation").when((F.col("e") > 0) & (F.col("e") < 1), "reallocate_tasks").otherwise("none")
    return t.select("trace", action.alias("action"), F.round("e", 6).alias("error_rate"), "slow")


@query("""SELECT user_id, round(greatest(0, least(1, CASE WHEN errors = 0 THEN 0.8 ELSE 0.4 END - least(errors * 0.1::DOUBLE, 0.3) + least(tools * 0.02::DOUBLE, 0.1))), 6) AS confidence, errors > 2 AS many_errors, tools > 10 AS many_tools FROM
(SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, count(*) AS tools FROM events GROUP BY user_id)""")
def reflection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G24, C13."""
    t = load(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(bad().cast("long")).alias("e"), F.count("*").alias("n"))
    c = F.when(F.col("e") == 0, 0.8).otherwise(0.4) - F.least(F.col("e") * 0.1, F.lit(0.3)) + F.least(F.col("n") * 0.02, F.lit(0.1))
    return t.select("user_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6).alias("confidence"), (F.col("e") > 2).alias("many_errors"), (F.col("n") > 10).alias("many_tools"))


@query("""SELECT o_custkey AS list_id, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS completed, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS pending, round(100.0::DOUBLE * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*), 4) AS progress, bool_and(o_orderstatus = 'F') AS is_complete FROM orders GROUP BY o_custkey""")
def task_list_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of states and progress of task lists, here a customer's orders."""
    done, open_ = (F.col("o_orderstatus") == "F"), (F.col("o_orderstatus") == "O")
    return load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("list_id")).agg(F.sum(done.cast("long")).alias("completed"), F.sum(open_.cast("long")).alias("pending"), F.round(100.0 * F.sum(done.cast("long")) / F.count("*"), 4).alias("progress"), F.bool_and(done).alias("is_complete"))


@query("""SELECT o_orderpriority AS role, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS p FROM orders GROUP BY o_orderpriority""")
def team_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pivot of states."""
    p = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("role")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return p.select("role", *(F.col(c).alias(c.lower()) for c in ("F", "O", "P")))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS spend FROM events GROUP BY 1""")
def hourly_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend in windows of an hour (aligned)."""
    hour = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd HH")
    return load(spark, sf_dir, "events").groupBy(hour.alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("spend"))


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS rows, '{"level":"' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || '","msg":"' || event_type || '"}' AS line FROM events GROUP BY event_type""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured log lines; nulls are left out."""
    rows = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("rows"))
    return rows.select("event_type", "rows", F.to_json(F.struct(F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.col("event_type").alias("msg"), F.lit(None).cast("string").alias("extra"))).alias("line"))


@query("SELECT 'cost report' || chr(10) || string_agg(event_type || ': ' || n, chr(10) ORDER BY event_type) AS report FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: a report's lines, over an aggregate of few rows."""
    rows = load(spark, sf_dir, "events").groupBy("event_type").count()
    return rows.agg(F.concat(F.lit("cost report\n"), F.array_join(F.array_sort(F.collect_list(F.concat("event_type", F.lit(": "), F.col("count").cast("string")))), "\n")).alias("report"))


@query("""SELECT user_id AS agent, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS turns, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS tool_calls FROM events GROUP BY user_id""")
def subagent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and tool calls of each agent."""
    count = lambda kind: F.sum((F.col("event_type") == kind).cast("long"))
    return load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("agent")).agg(count("view").alias("turns"), count("click").alias("tool_calls"))


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS updates, CAST(count(DISTINCT event_type) AS BIGINT) AS listeners, CAST(sum(CASE WHEN new THEN 1 ELSE 0 END) AS BIGINT) AS changes FROM
(SELECT user_id, event_type, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS new FROM events) GROUP BY user_id""")
def state_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of a store, and those that change its state."""
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = load(spark, sf_dir, "events").select("user_id", "event_type", (~F.col("event_type").eqNullSafe(before)).alias("new"))
    return rows.groupBy("user_id").agg(F.count("*").alias("updates"), F.countDistinct("event_type").alias("listeners"), F.sum(F.col("new").cast("long")).alias("changes"))
