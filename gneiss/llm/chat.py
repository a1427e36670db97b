"""Transcript parsing: a hidden Markov model recovers the roles of lines, then turns are rendered canonically.

A line's symbol combines its speaker marker, if any, with its length, whether it asks and whether it is
a list or code line. Each role has two states, for the line that begins a turn and for the lines within it:
only the first may be marked, and a turn of the same role can't follow without one of another or a marker.
Emissions and transitions are counted over labelled lines and smoothed. Decoding is Viterbi's. A transcript may be as long as the input: lines are range-partitioned by (transcript, order), so
a long one covers several partitions; each partition returns, for the transcripts at its edges only, a matrix
of best scores from any state before to any state after; the driver chains those few matrices, and each
partition then decodes alone, between known states.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from gneiss.session import cut, ship

ROLES = ("system", "user", "assistant")
#: The names that speakers have, by role.
NAMES = {
    "system": "system|instruction|instructions|context",
    "user": "user|human|question|q|prompter|customer|me",
    "assistant": "assistant|ai|bot|gpt|answer|a|model|agent",
}
MARKER = re.compile(r"\s*(?:(?:\*\*|#+ *|>+ *)?(?:" + "|".join(f"(?P<{r}>{n})" for r, n in NAMES.items()) + r")(?:\*\*)? *:|<\|?(?:im_start\|>)?(?P<tag>system|user|assistant)\|?>|\[(?P<box>system|user|assistant)\])", re.I)
#: Line lengths that part the classes of lengths.
SIZES = (1, 20, 40, 80, 120, 200, 300, 450, 700)
SYMBOLS = 4 * (len(SIZES) + 1) * 2 * 2
#: A state is twice its role's number, plus one within a turn.
STATES = 2 * len(ROLES)
#: Pseudo-counts: of each symbol in each state, of a marker's symbols in its own state, of each possible step; and what stands for none.
FLAT, OWN, STEP, NONE = 0.5, 50.0, 0.5, 1e-9


def marker(line: str) -> tuple[int, int]:
    """(1 + the role's number, the marker's length), or (0, 0)."""
    m = MARKER.match(line)
    if not m:
        return 0, 0
    role = (m["tag"] or m["box"] or m.lastgroup or "").lower()
    return 1 + ROLES.index(role), m.end()


def symbol(line: str) -> int:
    """The observation that a line is."""
    said, at = marker(line)
    rest = line[at:].strip()
    size = bisect_right(SIZES, len(rest))
    return ((said * (len(SIZES) + 1) + size) * 2 + rest.endswith("?")) * 2 + bool(re.match(r"[-*+] |\d+[.)] |```|    ", line[at:].lstrip() or " "))


class Model:
    """Log probabilities: start (STATES), step (STATES, STATES) and shown (STATES, SYMBOLS)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, shown: np.ndarray):
        own, said = np.full((STATES, SYMBOLS), FLAT), np.arange(SYMBOLS) // (SYMBOLS // 4)
        possible = np.zeros((STATES, STATES))
        for s in range(STATES):
            if s % 2:
                own[s, said > 0] = NONE  # a marker always begins a turn
            else:
                own[s, said == 1 + s // 2] += OWN
                own[s, (said > 0) & (said != 1 + s // 2)] = NONE
            possible[s, ::2] = STEP
            possible[s, s | 1] = STEP
        mine = np.where(np.arange(STATES) % 2 == 0, 1.0, NONE)
        self.start = np.log((start + mine) / (start + mine).sum())
        step = step + np.maximum(possible, NONE)
        self.step = np.log(step / step.sum(axis=1, keepdims=True))
        shown = shown * (own > NONE) + own
        self.shown = np.log(shown / shown.sum(axis=1, keepdims=True))

    def through(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(STATES + 1, STATES) best scores from each state before (last row: from the start) to each last state, and the first line's state on that path."""
        first = np.vstack([self.step, self.start])
        score = first + self.shown[:, seen[0]][None, :]
        lead = np.broadcast_to(np.arange(STATES), (STATES + 1, STATES)).copy()
        for s in seen[1:]:
            both = score[:, :, None] + self.step[None, :, :]
            k = both.argmax(axis=1)
            score = np.take_along_axis(both, k[:, None, :], axis=1)[:, 0, :] + self.shown[:, s][None, :]
            lead = np.take_along_axis(lead, k, axis=1)
        return score, lead

    def decode(self, seen: np.ndarray, before: int | None = None, last: int | None = None) -> list[int]:
        """The best states, after a known state and up to a known last state where given."""
        into, shown = self.step.T.tolist(), self.shown.T.tolist()
        score = [a + b for a, b in zip((self.start if before is None else self.step[before]).tolist(), shown[seen[0]])]
        back = []
        for s in seen[1:].tolist():
            came, new = [], []
            for j, say in enumerate(shown[s]):
                both = [a + b for a, b in zip(score, into[j])]
                top = max(both)
                came.append(both.index(top))
                new.append(top + say)
            back.append(came)
            score = new
        state = score.index(max(score)) if last is None else last
        path = [state]
        for came in reversed(back):
            path.append(state := came[state])
        return path[::-1]


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> tuple[pa.Table | None, list[tuple[int, int]]]:
    """A partition's rows and the (begin, end) of its transcripts."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return None, []
    t = pa.Table.from_batches(parts).combine_chunks()
    k = t.column(key).to_pylist()
    ends = [n for n in range(1, len(k)) if k[n] != k[n - 1]]
    return t, list(zip([0, *ends], [*ends, len(k)]))


def fit(lines: DataFrame) -> Model:
    """A model from lines with columns conv_id, turn, line_no, line, role; lines of other roles are left out.

    A row's first line begins a turn, the others are within it; the next turn number's role follows. Null
    roles teach nothing, a null line is an empty one, and repeated rows count once for steps.
    """
    ship(lines.sparkSession)
    known = lines.where(F.col("role").isin(*ROLES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        for b in batches:
            for role, inside, line in zip(b.column("role").to_pylist(), b.column("inside").to_pylist(), b.column("line").to_pylist()):
                k = (2 * ROLES.index(role) + inside, symbol(line or ""))
                counts[k] = counts.get(k, 0) + 1
        if counts:
            yield pa.RecordBatch.from_pylist([{"state": r, "symbol": s, "n": n} for (r, s), n in counts.items()])

    start, step, shown = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
    for r in known.select("role", (F.coalesce("line_no", F.lit(0)) > 0).cast("int").alias("inside"), "line").mapInArrow(run, "state long, symbol long, n long").groupBy("state", "symbol").agg(F.sum("n").alias("n")).collect():
        shown[r.state, r.symbol] += r.n
    rows = known.groupBy("conv_id", "turn", "role").agg(F.countDistinct("line_no").alias("n"))
    within, more = F.sum(F.greatest(F.col("n") - 2, F.lit(0))), F.sum((F.col("n") > 1).cast("long"))
    for r in rows.groupBy("role", (F.col("turn") == 0).alias("first")).agg(within.alias("within"), more.alias("more"), F.count("*").alias("rows")).collect():
        k = 2 * ROLES.index(r.role)
        step[k, k + 1] += r.more
        step[k + 1, k + 1] += r.within
        start[k] += r.rows if r.first else 0
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    for r in rows.join(after, ["conv_id", "turn"]).groupBy("role", "next", (F.col("n") > 1).cast("int").alias("inside")).count().collect():
        step[2 * ROLES.index(r.role) + r.inside, 2 * ROLES.index(r.next)] += r["count"]
    return Model(start, step, shown)


def parse(lines: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """conv_id, turn, line_no, ``carry``, role_pred, begins and rendered, a row for each line.

    Lines of a conv_id (null is one too) are in the order of turn, line_no and the line's hash. ``rendered``,
    put together in that order, is the canonical transcript: a role tag before a turn, the line without its
    marker, and an end tag after the turn. A null line is an empty one; repeated rows are lines of their own.
    """
    spark = lines.sparkSession
    ship(spark)
    order = ["conv_id", "turn", "line_no"]
    src = lines.select(*order, *carry, F.coalesce(F.col("line").cast("string"), F.lit("")).alias("line"))
    ordered = cut(src.withColumn("_h", F.xxhash64("line")).repartitionByRange(*order, "_h").sortWithinPartitions(*order, "_h").drop("_h"))
    sent = spark.sparkContext.broadcast(model)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, runs = _runs(batches, "conv_id")
        for n in sorted({0, len(runs) - 1}) if runs else ():
            a, b = runs[n]
            score, lead = sent.value.through(np.array([symbol(x) for x in t.column("line")[a:b].to_pylist()]))
            key = t.column("conv_id")[a].as_py()
            kinds = pa.schema([("part", pa.int64()), ("run", pa.int64()), ("runs", pa.int64()), ("key", pa.string()), ("score", pa.list_(pa.float64())), ("lead", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "run": n, "runs": len(runs), "key": None if key is None else str(key), "score": score.ravel().tolist(), "lead": lead.ravel().tolist()}], kinds)

    got = sorted(ordered.mapInArrow(edges, "part long, run long, runs long, key string, score array<double>, lead array<long>").collect(), key=lambda r: (r.part, r.run))  # two rows a partition
    fixed: dict[tuple[int, int], tuple[int | None, int | None, int | None]] = {}
    chain: list = []
    for r, nxt in zip(got, [*got[1:], None]):
        chain.append(r)
        if nxt is not None and nxt.part != r.part and nxt.key == r.key and r.run == r.runs - 1:
            continue
        if len(chain) > 1:
            at, back = np.array(chain[0].score).reshape(-1, STATES)[STATES], []
            for c in chain[1:]:
                both = at[:, None] + np.array(c.score).reshape(-1, STATES)[:STATES]
                back.append(both.argmax(axis=0))
                at = both.max(axis=0)
            states = [int(at.argmax())]
            for k in reversed(back):
                states.append(int(k[states[-1]]))
            states.reverse()  # the last state of each
            leads = [int(np.array(c.lead).reshape(-1, STATES)[STATES if n == 0 else states[n - 1], states[n]]) for n, c in enumerate(chain)]
            for n, c in enumerate(chain):
                fixed[(c.part, c.run)] = (states[n - 1] if n else None, states[n], leads[n + 1] if n + 1 < len(chain) else None)
        chain = []
    known = spark.sparkContext.broadcast(fixed)
    keep = [*order, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, runs = _runs(batches, "conv_id")
        part = TaskContext.get().partitionId()
        if t is None:
            return
        roles, begins, shown = [], [], []
        for n, (a, b) in enumerate(runs):
            text = t.column("line")[a:b].to_pylist()
            before, last, after = known.value.get((part, n), (None, None, None))
            path = sent.value.decode(np.array([symbol(x) for x in text]), before, last)
            for k, (line, s) in enumerate(zip(text, path)):
                at = marker(line)[1]
                role, new = ROLES[s // 2], s % 2 == 0
                follows = path[k + 1] if k + 1 < len(path) else after
                ends = follows is None or follows % 2 == 0
                roles.append(role)
                begins.append(new)
                shown.append((f"<|{role}|>\n" if new else "") + (line[at:].lstrip() if at else line) + ("<|end|>\n" if ends else "\n"))
        yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in keep), pa.array(roles), pa.array(begins), pa.array(shown, pa.string())], names=[*keep, "role_pred", "begins", "rendered"])

    schema = StructType([*(f for f in ordered.schema.fields if f.name != "line"), StructField("role_pred", StringType()), StructField("begins", BooleanType()), StructField("rendered", StringType())])
    return ordered.mapInArrow(run, schema)


#: How the registered query writes speakers: by conversation, one of these.
STYLES = {"system": ("System: ", "### Instruction: ", "<|system|>", "[system] "), "user": ("User: ", "### Human: ", "<|user|>", "Q: "), "assistant": ("Assistant: ", "### AI: ", "<|assistant|>", "A: ")}


def transcript_lines(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, line_no, line, role of plain transcripts: a row's first line has its speaker's marker, except in every third row."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4)).cast("int") + 1
    said = F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) == 0, F.lit(""))
    for role, marks in STYLES.items():
        said = said.when(F.col("role") == role, F.element_at(F.array(*map(F.lit, marks)), style))
    texts = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.concat(F.coalesce(said, F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    return texts.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
