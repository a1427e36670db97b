"""Queries over task graphs, import graphs, logs and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.plans.base import load, query

# Tasks are orders: a task depends on those of a half and a third of its key; it is complete where its status is F.
TASK_SQL = "t AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS done, o_orderpriority AS priority FROM orders), d AS (SELECT id, id // 2 AS dep FROM t UNION SELECT id, id // 3 FROM t)"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("done"), F.col("o_orderpriority").alias("priority"))


def dependencies(t: DataFrame) -> DataFrame:
    return t.select("id", F.explode(F.array_distinct(F.array(F.floor(F.col("id") / 2), F.floor(F.col("id") / 3)))).alias("dep"))


@query(f"WITH {TASK_SQL} SELECT id, priority FROM t WHERE NOT done AND NOT EXISTS (SELECT 1 FROM d JOIN t x ON x.id = d.dep WHERE d.id = t.id AND NOT x.done AND x.id <> t.id) ORDER BY priority, id")
def ready_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``ready_frontier``, under the name that the reference's callers know."""
    return ready_frontier(spark, sf_dir)


@query(f"WITH {TASK_SQL} SELECT id, priority FROM t WHERE NOT done AND NOT EXISTS (SELECT 1 FROM d JOIN t x ON x.id = d.dep WHERE d.id = t.id AND NOT x.done AND x.id <> t.id) ORDER BY priority, id")
def ready_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task whose dependencies are all complete, by priority."""
    t = tasks(spark, sf_dir)
    waiting = dependencies(t).join(t.where(~F.col("done")).select(F.col("id").alias("dep")), "dep", "left_semi").where("id <> dep").select("id")
    return t.where(~F.col("done")).join(waiting, "id", "left_anti").select("id", "priority").orderBy("priority", "id")


@query(f"WITH {TASK_SQL} SELECT priority, CAST(count(*) AS BIGINT) AS n, round(100.0::DOUBLE * sum(CASE WHEN done THEN 1 ELSE 0 END) / count(*), 4) AS progress FROM t GROUP BY priority")
def graph_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1."""
    return tasks(spark, sf_dir).groupBy("priority").agg(F.count("*").alias("n"), F.round(100.0 * F.sum(F.col("done").cast("long")) / F.count("*"), 4).alias("progress"))


# Modules are orders. Module n imports n / 2, then n / 3, and every 16th then 4 n, if there is one; its area goes by n mod 7.
EDGE_SQL = "e AS (SELECT s, t, pos FROM (SELECT o_orderkey AS s, 0 AS pos, o_orderkey // 2 AS t FROM orders UNION ALL SELECT o_orderkey, 1, o_orderkey // 3 FROM orders UNION ALL SELECT o.o_orderkey, 2, p.o_orderkey FROM orders o JOIN orders p ON p.o_orderkey = 4 * o.o_orderkey WHERE o.o_orderkey % 16 = 0) WHERE s <> t)"
#: Areas, and those that each may import (null: any). Configurations are imported last.
AREAS = {"port_entry": None, "wrap_src": ("port_entry", "wrap_config", "wrap_src"), "wrap_config": (), "business_src": ("wrap_src", "business_config", "business_src"), "business_config": (), "test_src": ("business_src", "test_config", "test_src"), "test_config": ()}
AREA = "CASE {0} % 7 " + " ".join(f"WHEN {n} THEN '{a}'" for n, a in enumerate(AREAS)) + " END"
ALLOWED = " OR ".join(f"(a = '{a}' AND b IN ({', '.join(repr(x) for x in to)}))" if to else f"a = '{a}'" for a, to in AREAS.items() if to is None or to)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, t, pos: imports in order."""
    k = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s"))
    near = k.select("s", F.posexplode(F.array(F.floor(F.col("s") / 2), F.floor(F.col("s") / 3))).alias("pos", "t"))
    far = k.where("s % 16 = 0").select("s", F.lit(2).alias("pos"), (4 * F.col("s")).alias("t")).join(k.select(F.col("s").alias("t")), "t", "left_semi")
    return near.unionByName(far).where("s <> t")


@query(f"""WITH RECURSIVE {EDGE_SQL}, r(s, t) AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s)
SELECT a.s AS node, CAST(min(least(a.s, a.t)) AS BIGINT) AS component FROM r a JOIN r b ON a.s = b.t AND a.t = b.s GROUP BY a.s""")
def dep_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: modules that reach themselves, and the smallest module of their cycle's component."""
    from gneiss.operators.components import strong_components

    return strong_components(edges(spark, sf_dir).select("s", "t"))


@query(f"WITH {EDGE_SQL} SELECT area, CAST(count(*) AS BIGINT) AS sinks FROM (SELECT o_orderkey AS node, {AREA.format('o_orderkey')} AS area FROM orders) n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.t = n.node AND {AREA.format('e.s')} = n.area) GROUP BY area")
def area_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that none of their own area imports."""
    return sinks(spark, sf_dir).groupBy("area").agg(F.count("*").alias("sinks"))


def sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, area of modules that none of their own area imports."""
    nodes = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.expr(AREA.format("o_orderkey")).alias("area"))
    inner = edges(spark, sf_dir).select(F.col("t").alias("node"), F.expr(AREA.format("s")).alias("area"))
    return nodes.join(inner, ["node", "area"], "left_anti")


@query(f"""WITH {EDGE_SQL}, k AS (SELECT node, area FROM (SELECT o_orderkey AS node, {AREA.format('o_orderkey')} AS area FROM orders) n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.t = n.node AND {AREA.format('e.s')} = n.area))
SELECT 'one business sink' AS rule, CAST(NULL AS BIGINT) AS node, CAST(count(*) AS BIGINT) AS n FROM k WHERE area = 'business_src' HAVING count(*) <> 1
UNION ALL SELECT 'wrap sinks are used', node, 1 FROM k WHERE area = 'wrap_src' AND NOT EXISTS (SELECT 1 FROM e WHERE e.t = k.node AND {AREA.format('e.s')} = 'business_src')""")
def sink_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The business area has exactly one sink, and every sink of the wrapping area is imported by business."""
    k = sinks(spark, sf_dir)
    one = k.where("area = 'business_src'").agg(F.count("*").alias("n")).where("n <> 1").select(F.lit("one business sink").alias("rule"), F.lit(None).cast("long").alias("node"), "n")
    used = edges(spark, sf_dir).where(F.expr(AREA.format("s")) == "business_src").select(F.col("t").alias("node"))
    return one.unionByName(k.where("area = 'wrap_src'").join(used, "node", "left_anti").select(F.lit("wrap sinks are used").alias("rule"), "node", F.lit(1).cast("long").alias("n")))


@query(f"WITH {EDGE_SQL} SELECT s, t, a || ' -> ' || b AS rule FROM (SELECT s, t, {AREA.format('s')} AS a, {AREA.format('t')} AS b FROM e) WHERE NOT ({ALLOWED})")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 (rules): imports of areas that the importing area may not import."""
    e = edges(spark, sf_dir).select("s", "t", F.expr(AREA.format("s")).alias("a"), F.expr(AREA.format("t")).alias("b"))
    return e.where(f"NOT ({ALLOWED})").select("s", "t", F.concat("a", F.lit(" -> "), "b").alias("rule"))


@query(f"WITH {EDGE_SQL}, o AS (SELECT s, t, pos, {AREA.format('t')} IN ('wrap_config', 'business_config', 'test_config') AS c, lag(c) OVER w AS before, bool_or(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e WINDOW w AS (PARTITION BY s ORDER BY pos)) SELECT s, t, pos, before AS right_after FROM o WHERE NOT c AND seen")
def config_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 (order): imports that come after a configuration's, which should be last; right_after: the one before it was one. A window is a module's imports."""
    w = Window.partitionBy("s").orderBy("pos")
    e = edges(spark, sf_dir).withColumn("c", F.expr(AREA.format("t")).endswith("_config"))
    e = e.withColumns({"right_after": F.lag("c").over(w), "seen": F.max("c").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return e.where("NOT c AND seen").select("s", "t", "pos", "right_after")


@query("""SELECT p_partkey AS module, min(CASE WHEN s_suppkey = p_partkey THEN 0 WHEN s_suppkey = p_partkey // 2 THEN 1 ELSE 2 END) AS place FROM part JOIN supplier ON s_suppkey IN (p_partkey, p_partkey // 2, p_partkey // 4) GROUP BY p_partkey""")
def import_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a module's candidate files that exists."""
    k = F.col("p_partkey")
    c = load(spark, sf_dir, "part").select(k.alias("module"), F.posexplode(F.array(k, F.floor(k / 2), F.floor(k / 4))).alias("place", "s_suppkey"))
    return c.join(load(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").groupBy("module").agg(F.min("place").alias("place"))


AGENTS = ((0, "ASIA", ("read", "write")), (1, "EUROPE", ("read",)), (2, "AMERICA", ("read", "write", "run")))
NEED = "CASE WHEN n_nationkey % 3 = 0 THEN 'read,write' WHEN n_nationkey % 3 = 1 THEN 'read' ELSE 'run' END"
AGENT_ROWS = ", ".join(f"({i}, '{r}', ['" + "', '".join(c) + "'])" for i, r, c in AGENTS)


@query(f"SELECT n_nationkey AS task, min(a.id) AS agent FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (VALUES {AGENT_ROWS}) a(id, role, caps) ON a.role = r_name AND list_has_all(a.caps, string_split({NEED}, ',')) GROUP BY n_nationkey")
def task_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first agent of the role with every capability."""
    agents = spark.createDataFrame(list(AGENTS), "id int, role string, caps array<string>")  # three rows
    t = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("task"), F.col("r_name").alias("role"), F.split(F.expr(NEED), ",").alias("need"))
    return t.join(F.broadcast(agents), "role").where(F.size(F.array_except("need", "caps")) == 0).groupBy("task").agg(F.min("id").alias("agent"))


# State from events: key = user_id, a write's value is props.k, events of type 'error' delete.
@query("""SELECT user_id, CAST(arg_max(json_extract_string(props, '$.k'), event_id) AS BIGINT) AS value, CAST(max(event_id) AS BIGINT) AS version FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'""")
def kv_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2, M1, M5: last write wins; deleted keys are gone."""
    e = load(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "props"), "event_id").alias("l"), F.max("event_id").alias("version"))
    return last.where("l.event_type <> 'error'").select("user_id", F.get_json_object("l.props", "$.k").cast("long").alias("value"), "version")


@query("""WITH d AS (SELECT user_id AS session, event_id AS delta, (event_id // 7) % 50 AS pos, event_type AS msg FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY session, pos ORDER BY delta) AS n FROM d)
SELECT session, pos, msg FROM k WHERE n = 1""")
def delta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: deltas merged by offset; where they overlap, the first delta's message stays."""
    d = load(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("delta"), (F.floor(F.col("event_id") / 7) % 50).alias("pos"), F.col("event_type").alias("msg"))
    return d.groupBy("session", "pos").agg(F.min_by("msg", "delta").alias("msg"))


@query("""WITH a AS (SELECT DISTINCT user_id AS agent FROM events), m AS (SELECT event_id, user_id AS sender FROM events WHERE event_type = 'signup')
SELECT agent, CAST(count(*) AS BIGINT) AS received, CAST(max(event_id) AS BIGINT) AS last_message FROM a JOIN m ON a.agent <> m.sender GROUP BY agent""")
def mailbox_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: a broadcast reaches all but its sender: totals less own ones, so messages and agents are never paired."""
    e = load(spark, sf_dir, "events")
    by = e.groupBy(F.col("user_id").alias("agent")).agg(F.count(F.when(F.col("event_type") == "signup", 1)).alias("own"), F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("newest"))  # a row an agent
    total = F.broadcast(by.agg(F.sum("own").alias("all"), F.max(F.struct("newest", "agent")).alias("top")))  # one row
    second = F.broadcast(by.crossJoin(total).where("agent <> top.agent").agg(F.max("newest").alias("second")))  # one row
    rows = by.crossJoin(total).crossJoin(second)
    newest = F.when(F.col("agent") == F.col("top.agent"), F.col("second")).otherwise(F.col("top.newest"))
    return rows.select("agent", (F.col("all") - F.col("own")).alias("received"), newest.alias("last_message")).where("received > 0")


@query("SELECT event_id, user_id FROM events WHERE value IS NULL OR event_id * 10 + value >= 90000")
def ttl_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: entries that haven't expired at a fixed time; null never expires."""
    return load(spark, sf_dir, "events").where(F.col("value").isNull() | (F.col("event_id") * 10 + F.col("value") >= 90000)).select("event_id", "user_id")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(k) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)) WHERE used <= 2000 AND n <= 30""")
def evict_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most important entries within a token and an entry budget."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    rows = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.withColumn("used", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(w)).where("used <= 2000 AND n <= 30").select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 5")
def keep_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five of each key."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return load(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n <= 5").select("user_id", "event_id")


@query("""SELECT user_id, CASE WHEN coalesce(b, '') <> '' THEN b ELSE a END AS merged, array_to_string(list_sort(list_distinct(list_concat(x, y))), ',') AS tags FROM
(SELECT user_id, min(event_type) AS a, max(CASE WHEN event_type > 'p' THEN event_type END) AS b, list(DISTINCT event_type) FILTER (event_id % 2 = 0) AS x, list(DISTINCT event_type) FILTER (event_id % 2 = 1) AS y FROM events GROUP BY user_id) WHERE x IS NOT NULL AND y IS NOT NULL""")
def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right side wins unless it is empty; lists are united."""
    e = load(spark, sf_dir, "events")
    t = F.col("event_type")
    g = e.groupBy("user_id").agg(F.min(t).alias("a"), F.max(F.when(t > "p", t)).alias("b"), F.collect_set(F.when(F.col("event_id") % 2 == 0, t)).alias("x"), F.collect_set(F.when(F.col("event_id") % 2 == 1, t)).alias("y"))
    return g.where((F.size("x") > 0) & (F.size("y") > 0)).select("user_id", F.coalesce(F.expr("nullif(b, '')"), "a").alias("merged"), F.array_join(F.array_sort(F.array_union("x", "y")), ",").alias("tags"))
