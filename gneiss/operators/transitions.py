"""State machines over logs of events, as functions from state to state, whose composition is associative."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from gneiss.session import cut, ship

#: A slot of a task graph. Nothing but an assignment is valid before there is a slot.
SLOT = ("none", {("none", "assign"): "pending", **{(s, o): t for s in ("pending", "running", "completed", "failed") for o, t in (("assign", "pending"), ("start", "running"), ("complete", "completed"), ("fail", "failed"))}})
#: A task posted to a team. It is claimed once, completed by who claimed it, and can always fail.
POSTING = (
    "none",
    {
        ("none", "post"): "open",
        ("open", "claim"): "claimed",
        **{(s, "complete"): "completed" for s in ("claimed", "completed", "failed")},
        **{(s, "fail"): "failed" for s in ("claimed", "completed", "failed")},
        **{(s, "fail"): "failed unclaimed" for s in ("open", "failed unclaimed")},
    },
)


def replay(events: DataFrame, machine: tuple[str, dict[tuple[str, str], str]]) -> DataFrame:
    """key, seq, op, before, after, valid of every event, in order of seq.

    ``events`` has key, seq (long, unique for a key, else equal ones go by op) and op. An operation that
    the machine doesn't have for a state is invalid and changes nothing.

    Events are cut into stretches of seq, about as wide as their number. A stretch of a key is folded to a
    function, one state for each state it may be entered with; functions are composed in order, which gives
    the state that every stretch is entered with, and stretches are replayed from there. So a key with a
    third of all events is in as many tasks as it has stretches. Null keys are one key; rows with a null
    seq are left out.
    """
    start, moves = machine
    spark = events.sparkSession
    ship(spark)
    states = sorted({start, *(s for s, _ in moves), *moves.values()})
    number = {s: n for n, s in enumerate(states)}
    ops = sorted({o for _, o in moves})
    rows = events.select("key", F.col("seq").cast("long").alias("seq"), "op").where("seq IS NOT NULL")
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    if low is None:
        low = high = 0
    width = max(1, int((high - low + 1) ** 0.5))  # as many stretches as places in one
    rows = cut(rows.withColumn("stretch", F.floor((F.col("seq") - low) / width)))
    # A function is an array: place n has the state that state n becomes.
    identity = F.array(*map(F.lit, range(len(states))))
    effect = F.create_map(*(x for o in ops for x in (F.lit(o), F.array(*(F.lit(number[moves.get((s, o), s)]) for s in states)))))
    run = F.array_sort(F.collect_list(F.struct("seq", "op")))
    step = F.aggregate("run", identity, lambda f, e: F.transform(f, lambda s: F.coalesce(F.get(F.try_element_at(effect, e["op"]), s), s)))
    functions = rows.groupBy("key", "stretch").agg(run.alias("run")).select("key", "stretch", step.alias("f"))
    ordered = functions.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("stretch", "f"))).alias("fs"))  # a row a stretch
    begin = F.struct(F.lit(number[start]).alias("s"), F.array().cast("array<int>").alias("seen"))
    entered = F.aggregate("fs", begin, lambda a, x: F.struct(F.get(x["f"], a["s"]).alias("s"), F.concat(a["seen"], F.array(a["s"])).alias("seen")), lambda a: a["seen"])
    entries = ordered.select("key", F.explode(F.arrays_zip(F.transform("fs", lambda x: x["stretch"]).alias("stretch"), entered.alias("entry"))).alias("e")).select(F.col("key").alias("k2"), F.col("e.stretch").alias("s2"), F.col("e.entry").alias("entry"))
    known = rows.join(entries, [F.col("key").eqNullSafe(F.col("k2")), F.col("stretch") == F.col("s2")]).select("key", "seq", "op", "stretch", "entry")
    sort = [F.asc_nulls_first("key"), "stretch", "seq", "op"]
    known = known.repartition("key", "stretch").sortWithinPartitions(*sort)
    schema = StructType([*rows.schema.fields[:3], StructField("before", StringType()), StructField("after", StringType()), StructField("valid", BooleanType())])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, start
        for b in batches:
            out: list[tuple] = []
            for key, stretch, op, entry in zip(*(b.column(c).to_pylist() for c in ("key", "stretch", "op", "entry"))):
                if at != (key, stretch):
                    at, state = (key, stretch), states[entry]
                after = moves.get((state, op))
                out.append((state, after or state, after is not None))
                state = after or state
            cols = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "seq", "op")), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_())))], names=schema.names)

    return known.mapInArrow(told, schema)
