"""Queries over conversations: token accounting, sessions, extraction, compaction."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import compaction
from gneiss.plans.base import load, query
from gneiss.plans.text_queries import CJK_SQL
from gneiss.session import ship

WINDOW_TOKENS = 400
EST = f"CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, CAST(trunc(len(regexp_extract_all(text, '{CJK_SQL}')) / 1.5::DOUBLE + (length(text) - len(regexp_extract_all(text, '{CJK_SQL}'))) / 4.0::DOUBLE) AS BIGINT)) END"
MSG = f"(CASE role WHEN 'system' THEN 3 WHEN 'user' THEN 4 WHEN 'assistant' THEN 3 ELSE 0 END + {EST})"
DECISION = compaction.DECISION


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").withColumn("tokens", T.message_tokens(F.col("role"), F.col("text")))


@query(f"SELECT conv_id, turn, role, CAST({EST} AS BIGINT) AS content_tokens, CAST({MSG} AS BIGINT) AS tokens FROM conversations")
def message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1, C2."""
    return _messages(spark, sf_dir).select("conv_id", "turn", "role", T.estimate_tokens(F.col("text")).alias("content_tokens"), "tokens")


@query(f"""SELECT conv_id, CAST(count(*) AS BIGINT) AS messages, CAST(sum({MSG}) AS BIGINT) AS total_tokens, CAST(sum(CASE WHEN role = 'system' THEN {MSG} ELSE 0 END) AS BIGINT) AS system_tokens,
round(sum({MSG}) * 100.0::DOUBLE / {WINDOW_TOKENS}, 4) AS used_pct, sum({MSG}) * 100.0 / {WINDOW_TOKENS} >= 80 AS near_limit, sum({MSG}) * 100.0 / {WINDOW_TOKENS} >= 95 AS should_compact FROM conversations GROUP BY conv_id""")
def context_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3, G6, J2."""
    pct = F.sum("tokens") * 100.0 / WINDOW_TOKENS
    return _messages(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum("tokens").alias("total_tokens"), F.sum(F.when(F.col("role") == "system", F.col("tokens")).otherwise(0)).alias("system_tokens"), F.round(pct, 4).alias("used_pct"), (pct >= 80).alias("near_limit"), (pct >= 95).alias("should_compact"))


@query(f"SELECT conv_id, l.level, round(pct, 4) AS used_pct, pct >= greatest(60, 95 - 10 * l.level) AS triggers FROM (SELECT conv_id, sum({MSG}) * 100.0::DOUBLE / {WINDOW_TOKENS} AS pct FROM conversations GROUP BY conv_id), (VALUES (0), (1), (2), (3), (4)) l(level)")
def compaction_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4."""
    pct = _messages(spark, sf_dir).groupBy("conv_id").agg((F.sum("tokens") * 100.0 / WINDOW_TOKENS).alias("pct"))
    return pct.select("conv_id", F.explode(F.array(*map(F.lit, range(5)))).alias("level"), "pct").select("conv_id", "level", F.round("pct", 4).alias("used_pct"), (F.col("pct") >= F.greatest(F.lit(60), 95 - 10 * F.col("level"))).alias("triggers"))


@query("""WITH f AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM (SELECT conv_id, turn // 2 AS pair, turn, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role, text FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM f)
SELECT conv_id, CAST(island AS BIGINT) AS island, role, CAST(min(turn) AS BIGINT) AS first_turn, CAST(count(*) AS BIGINT) AS merged, CAST(sum(length(text)) AS BIGINT) AS chars FROM i GROUP BY conv_id, island, role""")
def role_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring messages of one role merged; system ones count as the user's."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = load(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("role") == "system", "user").otherwise(F.col("role")))
    rows = rows.withColumn("new", (~F.col("role").eqNullSafe(F.lag("role").over(w))).cast("int")).withColumn("island", F.sum("new").over(w))
    return rows.groupBy("conv_id", "island", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("merged"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT conv_id, left(coalesce(arg_min(text, turn) FILTER (role = 'user'), ''), 100) AS first_user, left(coalesce(arg_max(text, turn) FILTER (role IN ('user', 'assistant')), ''), 100) AS last_message, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id""")
def session_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G22."""
    cut = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(100))
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    last = F.max_by("text", F.when(F.col("role").isin("user", "assistant"), F.col("turn")))
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(cut(first).alias("first_user"), cut(last).alias("last_message"), F.count("*").alias("n"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 50")
def sessions_keep_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest sessions."""
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).orderBy(F.desc("conv_id")).limit(50)


@query(f"""SELECT DISTINCT conv_id, left(trim(s), 180) AS decision FROM (SELECT conv_id, unnest(string_split(replace(trim(text), chr(10), ' '), '. ')) AS s FROM conversations WHERE role = 'assistant') WHERE regexp_matches(s, '(?i)({DECISION})') AND trim(s) <> ''""")
def decisions_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different sentences that decide something."""
    s = F.split(F.replace(F.trim("text"), F.lit("\n"), F.lit(" ")), r"\. ", -1)
    rows = load(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", F.explode(F.filter(s, lambda x: x.rlike(f"(?i)({DECISION})"))).alias("s"))
    return rows.select("conv_id", F.left(F.trim("s"), F.lit(180)).alias("decision")).where("decision <> ''").distinct()


@query("""SELECT conv_id, turn, CASE WHEN length(p) > 200 THEN left(p, 200) || '...' ELSE p END AS intent FROM (SELECT conv_id, turn, replace(trim(text), chr(10), ' ') AS p FROM conversations WHERE role = 'user' AND trim(text) <> '')""")
def intents_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users ask, up to 200 characters."""
    p = F.replace(F.trim("text"), F.lit("\n"), F.lit(" "))
    return load(spark, sf_dir, "conversations").where("role = 'user' AND trim(text) <> ''").select("conv_id", "turn", F.when(F.length(p) > 200, F.concat(F.left(p, F.lit(200)), F.lit("..."))).otherwise(p).alias("intent"))


@query("""WITH t AS (SELECT user_id, event_id, event_type, props, lead(event_type) OVER w AS next_type, lead(event_id) OVER w AS next_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id AS call_id, next_id AS result_id, 'click ' || json_extract_string(props, '$.k') || ' -> ' || next_type AS summary FROM t WHERE event_type = 'click' AND next_type <> 'click'""")
def pair_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call and the row right after it, as one line."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    t = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props", F.lead("event_type").over(w).alias("next_type"), F.lead("event_id").over(w).alias("next_id"))
    return t.where("event_type = 'click' AND next_type <> 'click'").select("user_id", F.col("event_id").alias("call_id"), F.col("next_id").alias("result_id"), F.concat(F.lit("click "), F.get_json_object("props", "$.k"), F.lit(" -> "), "next_type").alias("summary"))


@query("""SELECT conv_id, turn, CASE WHEN starts_with(t, '<final>') THEN 'final' WHEN starts_with(t, '<progress>') THEN 'progress' ELSE 'plain' END AS kind, CAST(length(regexp_replace(t, '^<(final|progress)>|</(final|progress)>$', '', 'g')) AS BIGINT) AS chars FROM
(SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '<final>' || text || '</final>' WHEN 1 THEN '<progress>' || text || '</progress>' ELSE text END AS t FROM conversations WHERE text IS NOT NULL)""")
def assistant_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11."""
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<final>"), "text", F.lit("</final>"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("<progress>"), "text", F.lit("</progress>"))).otherwise(F.col("text"))
    kind = F.when(F.startswith("t", F.lit("<final>")), "final").when(F.startswith("t", F.lit("<progress>")), "progress").otherwise("plain")
    return load(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", t.alias("t")).select("conv_id", "turn", kind.alias("kind"), F.length(F.regexp_replace("t", "^<(final|progress)>|</(final|progress)>$", "")).cast("long").alias("chars"))


@query()
def compact_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7, C9."""
    return compaction.compacted(load(spark, sf_dir, "conversations"), WINDOW_TOKENS)


@query()
def compaction_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a compaction did to each conversation."""
    return compaction.history(load(spark, sf_dir, "conversations"), WINDOW_TOKENS)


#: How events stand for calls of tools: event type -> tool.
EVENT_TOOLS = {"click": "edit_file", "view": "read_file", "error": "run_command"}


def tool_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call and a result for each event of a user, with inputs, errors and long results."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props")
    tool = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in EVENT_TOOLS.items()], F.lit("grep_files"))
    given = F.to_json(F.struct(F.concat(F.lit("src/"), "event_id", F.lit(".py")).alias("path"), F.concat(F.lit("make "), "event_type").alias("command"), F.col("event_type").alias("pattern")))
    told = F.concat_ws("\n", F.concat(F.lit("exit code "), F.col("event_id") % 3), F.array_join(F.array_repeat("props", (F.col("event_id") % 7 * 60 + 1).cast("int")), "\n"))
    call = F.struct((2 * F.col("event_id")).alias("turn"), F.lit("assistant_tool_call").alias("role"), F.lit("").alias("text"), tool.alias("tool"), given.alias("input"), F.lit(False).alias("error"))
    result = F.struct((2 * F.col("event_id") + 1).alias("turn"), F.lit("tool_result").alias("role"), told.alias("text"), tool.alias("tool"), F.lit(None).cast("string").alias("input"), (F.col("event_type") == "error").alias("error"))
    return e.select(F.col("user_id").cast("long").alias("conv_id"), F.explode(F.array(call, result)).alias("m")).select("conv_id", "m.*")


@query()
def compact_tool_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 to C9 with limits, summaries and errors by kind of tool."""
    return compaction.compacted(tool_sessions(spark, sf_dir), 4000, 1)


@query()
def layered_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six layers within growing shares of a budget."""
    return compaction.summaries(load(spark, sf_dir, "conversations"), 120)


@query()
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a scope taken in order while the whole formatted text stays within the budget; at most 20 a scope."""
    from gneiss.operators.search import memory_search
    from gneiss.plans.search_queries import AS_OF, SEARCH, entries

    found = memory_search(entries(spark, sf_dir), SEARCH, AS_OF)
    best = reduce(DataFrame.unionByName, [found.where(F.col("scope") == k).orderBy(F.desc("total"), "id").limit(20) for k in range(3)])
    top = best.withColumn("n", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("total"), "id"))).select("scope", "n", "id", "content")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, text, kept, total = pdf.sort_values("n"), "", [], 0
        for r in pdf.itertuples():
            longer = text + f"- {r.content}\n"
            if compaction.tokens(longer) > 8000:
                if not kept:
                    continue
                break
            text, total = longer, compaction.tokens(longer)
            kept.append((r.scope, r.n, r.id, total))
        return pd.DataFrame(kept, columns=["scope", "n", "id", "tokens"])

    ship(spark)
    return top.groupBy("scope").applyInPandas(run, "scope long, n int, id long, tokens long")
