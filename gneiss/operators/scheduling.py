"""The schedule of a turn's tool calls: by reliability, split into concurrent and serial calls, with a number of workers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Conflicts that make a pair serial, workers at most, with writes, with commands.
CONFLICTS = 2
WORKERS, WRITERS, COMMANDS = 8, 4, 3

# Sequential by definition: a call joins the concurrent ones unless its tool conflicts with one that already has.
_CHOSEN = """CASE WHEN size(calls) = 1 THEN transform(calls, c -> c.call) ELSE aggregate(calls, named_struct('tools', CAST(array() AS array<{tool}>), 'ids', CAST(array() AS array<{call}>)),
(acc, c) -> IF(c.safe AND NOT arrays_overlap(acc.tools, c.foes), named_struct('tools', array_append(acc.tools, c.tool), 'ids', array_append(acc.ids, c.call)), acc), acc -> acc.ids) END"""


def schedule(calls: DataFrame, tools: DataFrame, conflicts: DataFrame) -> DataFrame:
    """turn, call, tool, place, concurrent and workers (of the turn) for every row of calls (turn, call, tool).

    tools (tool, rate, safe, writes, runs): one row a tool; an unknown one has rate 1 and is serial. conflicts (a, b, n): a pair of
    tools, a <= b, and how often they conflicted. Equal rates stay in the order of ``call``. A call that is alone is concurrent.
    """
    own = calls.select("turn", "tool").distinct()
    pair = own.select("turn", F.col("tool").alias("a")).join(own.select("turn", F.col("tool").alias("b")), "turn").where("a <= b")
    pair = pair.join(conflicts.where(F.col("n") >= CONFLICTS).select("a", "b"), ["a", "b"], "left_semi")
    foes = pair.select("turn", F.col("a").alias("tool"), F.col("b").alias("foe")).unionByName(pair.select("turn", F.col("b").alias("tool"), F.col("a").alias("foe"))).groupBy("turn", "tool").agg(F.collect_set("foe").alias("foes"))
    types = dict(calls.dtypes)
    rows = calls.join(tools, "tool", "left").join(foes, ["turn", "tool"], "left")
    no = F.lit(False)
    one = F.struct(
        (-F.coalesce("rate", F.lit(1.0))).alias("order"), "call", "tool", F.coalesce("safe", no).alias("safe"), F.coalesce("writes", no).alias("writes"), F.coalesce("runs", no).alias("runs"),
        F.coalesce("foes", F.array().cast(f"array<{types['tool']}>")).alias("foes"),
    )
    turns = rows.groupBy("turn").agg(F.array_sort(F.collect_list(one)).alias("calls")).withColumn("chosen", F.expr(_CHOSEN.format(**types)))
    of = "filter(calls, c -> array_contains(chosen, c.call))"
    most = F.expr(f"least({WORKERS}, size(chosen), IF(exists({of}, c -> c.writes), {WRITERS}, {WORKERS}), IF(exists({of}, c -> c.runs), {COMMANDS}, {WORKERS}))")
    placed = turns.withColumn("workers", F.greatest(F.lit(1), most)).select("turn", "chosen", "workers", F.posexplode("calls").alias("at", "c"))
    return placed.select("turn", "c.call", "c.tool", (F.col("at") + 1).alias("place"), F.expr("array_contains(chosen, c.call)").alias("concurrent"), "workers")
