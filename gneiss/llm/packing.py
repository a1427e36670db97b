"""Packing documents into sequences of 1024 tokens by cutting-stock column generation.

1. A document's ids are cut into whole sequences and a rest; a rest above half a sequence is cut once more,
   as two such rests never share a sequence. Lengths are counted in classes of UNIT, rounded up, so there
   are few classes whatever the size of the input, and the driver sees only the pieces' number by class and salt.
2. A linear program over patterns, each the classes that share one sequence, covers those counts with the
   fewest sequences. Columns come from an unbounded knapsack over the dual prices by dynamic programming;
   the basis is kept as an inverse.
3. Solutions are rounded down, then up while counts last. What no rounded pattern takes, less than one
   sequence a class, is packed by first fit in decreasing order, into patterns that are used once.
4. Each piece is ranked within its class and salt, a row's place modulo SALTS, so that a common length is
   dealt to many tasks; rank ranges of the patterns give its sequence and slot, and offsets are running
   sums within a sequence. Whole sequences need no order: they are numbered within their partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.bytebpe import byte_bpe, with_end
from gneiss.session import cut, ship

ROOM = 1024
END_ID = 0
SALTS = 256
#: The longest piece beside whole sequences.
PART = ROOM // 2
#: Tokens of a class of lengths.
UNIT = 4
#: Column generation stops at this gap to the lower bound, or after so many columns.
GAP = 0.001
PIVOTS = 6000
#: Columns that are tried for each solution of the knapsack.
COLUMNS = 4


def best_patterns(price: np.ndarray, room: int, most: int) -> list[np.ndarray]:
    """Unbounded knapsack by dynamic programming: for each first item, the best pattern that holds it; the best ``most``."""
    value = np.zeros(room + 1)
    last = np.zeros(room + 1, dtype=np.int64)
    p = np.where(price > 1e-9, price, -1.0)[1 : room + 1]
    for c in range(1, room + 1):
        v = value[c - 1 :: -1] + p[:c] if c < room + 1 else None
        k = int(v.argmax())
        if v[k] > value[c - 1] + 1e-12:
            value[c], last[c] = v[k], k + 1
        else:
            value[c] = value[c - 1]
    items = np.flatnonzero(p > 0) + 1
    total = value[room - items] + p[items - 1]
    found, seen = [], set()
    for item in items[np.argsort(-total, kind="stable")[:most]]:
        a = np.zeros(room + 1, dtype=np.int64)
        a[item] += 1
        c = room - int(item)
        while c > 0:
            if last[c]:
                a[last[c]] += 1
                c -= int(last[c])
            else:
                c -= 1
        if (key := a.tobytes()) not in seen:
            seen.add(key)
            found.append(a)
    return found


def solve(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Patterns (copies by length) and how often, from the linear program. demand[l]: pieces of class l, 1 <= l <= room."""
    lens = np.flatnonzero(demand[: room + 1])
    lens = lens[lens > 0]
    if not len(lens):
        return []
    per = room // lens
    inverse = np.diag(1.0 / per)
    x = demand[lens] / per
    patterns = [np.bincount([n], weights=[k], minlength=room + 1).astype(np.int64) for n, k in zip(lens, per)]
    least = float((demand[lens] * lens).sum()) / room
    for n in range(PIVOTS):
        if n == 0 or not waiting:
            dual = inverse.sum(axis=0)
            price = np.zeros(room + 1)
            price[lens] = dual
            waiting = best_patterns(price, room, COLUMNS)
            top = float(dual @ waiting[0][lens]) if waiting else 1.0
            bound = max(least, x.sum() / max(top, 1.0))
            if top <= 1 + 1e-9 or x.sum() - bound <= max(GAP * bound, 1e-6):
                break
        a = waiting.pop(0)
        if float(inverse.sum(axis=0) @ a[lens]) <= 1 + 1e-9:
            continue
        d = inverse @ a[lens]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            continue
        row = inverse[r] / d[r]
        step = ratio[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
        x = np.maximum(x - d * step, 0)
        x[r] = step
        patterns[r] = a
    return [(p, float(v)) for p, v in zip(patterns, x) if v > 1e-9]


@dataclass
class Plan:
    """Where the pieces of each class go, by rank: arrays of segments."""

    first: list[np.ndarray]  # by class: first rank of each segment
    copies: list[np.ndarray]
    sequence: list[np.ndarray]
    slot: list[np.ndarray]
    before: np.ndarray  # (class, salt): pieces of the class in smaller salts
    sequences: int


def make_plan(counts: np.ndarray, room: int) -> Plan:
    """counts: pieces by (class, salt). Deterministic; no pieces give an empty plan."""
    left = counts.sum(axis=1).astype(np.int64)
    chosen: list[tuple[np.ndarray, int]] = []
    parts = []
    for a, v in solve(left.copy(), room):
        n = min([int(np.floor(v + 1e-9)), *(left[a > 0] // a[a > 0])])
        left -= n * a
        parts.append([a, int(n), v - n])
    for part in sorted(parts, key=lambda p: -p[2]):  # rounded up while counts last, the fullest need first
        a = part[0]
        if part[2] > 0.5 and (left[a > 0] >= a[a > 0]).all():
            left -= a
            part[1] += 1
    chosen += [(a, n) for a, n, _ in parts if n]
    while left.any():  # bounded by the number of classes, not by the input
        a, free = np.zeros(room + 1, dtype=np.int64), room
        while len(fit := np.flatnonzero(left[: free + 1] - a[: free + 1])):
            l = int(fit[-1])
            n = min(free // l, int(left[l] - a[l]))
            a[l] += n
            free -= n * l
        left -= a
        chosen.append((a, 1))
    segs: list[list[tuple[int, int, int, int]]] = [[] for _ in range(room + 1)]
    taken, sequence = np.zeros(room + 1, dtype=np.int64), 0
    for a, n in chosen:
        slot = 0
        for l in np.flatnonzero(a)[::-1]:
            segs[l].append((int(taken[l]), int(a[l]), sequence, slot))
            taken[l] += n * a[l]
            slot += int(a[l])
        sequence += n
    column = lambda k: [np.array([s[k] for s in x], dtype=np.int64) for x in segs]
    return Plan(column(0), column(1), column(2), column(3), np.cumsum(counts, axis=1) - counts, sequence)


def place(plan: Plan, kind: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, slot) of pieces by class and rank within it."""
    sequence, slot = np.empty(len(kind), np.int64), np.empty(len(kind), np.int64)
    for l in np.unique(kind):
        own = np.flatnonzero(kind == l)
        k = np.searchsorted(plan.first[l], rank[own], side="right") - 1
        inside = rank[own] - plan.first[l][k]
        sequence[own] = plan.sequence[l][k] + inside // plan.copies[l][k]
        slot[own] = plan.slot[l][k] + inside % plan.copies[l][k]
    return sequence, slot


def cuts(n: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    whole = n // ROOM * ROOM
    ends = [*range(ROOM, whole + 1, ROOM), *range(whole + PART, n, PART), *([n] if n > whole else [])]
    return [(s, e - s) for s, e in zip([0, *ends], ends)]


def pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text_hash, start, length, ids_crc32, doc_tokens: each text's ids with END_ID, cut as ``cuts`` says."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(vocabulary)
        for b in batches:
            at = 0
            for ids, counts in encoder.encode_array(b.column("text")):
                ids, counts = with_end(ids, counts, END_ID)
                data, begin = memoryview(ids.tobytes()), 0
                row, start, length, crc = [], [], [], []
                for k, n in enumerate(counts.tolist(), at):
                    for s, size in cuts(n):
                        row.append(k)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(data[4 * (begin + s) : 4 * (begin + s + size)]))
                    begin += n
                which = pa.array(row, pa.int64())
                total = counts[np.array(row, dtype=np.int64) - at]
                at += len(counts)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(which), b.column("text_hash").take(which), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "text_hash", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of each document.

    Null texts count as empty, and an empty text is the one id END_ID. Null and repeated ids and repeated
    rows are documents like any other. Sequences are gapless from offset 0. Empty input gives no rows.
    """
    spark = docs.sparkSession
    kind = F.ceil(F.col("length") / UNIT).cast("int")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    rows = cut(pieces(docs, vocabulary).withColumns({"kind": kind, "salt": salt, "part": F.spark_partition_id()}))
    room = ROOM // UNIT
    full = F.col("length") == ROOM
    counts = np.zeros((room + 1, SALTS), dtype=np.int64)
    for r in rows.where(~full).groupBy("kind", "salt").count().collect():  # room * SALTS rows at most
        counts[r["kind"], r["salt"]] = r["count"]
    wholes = {r["part"]: r["count"] for r in rows.where(full).groupBy("part").count().collect()}  # a row a partition
    plan = spark.sparkContext.broadcast(make_plan(counts, room))  # at most room patterns of few classes each, and those used once
    packed = plan.value.sequences
    ahead = dict(zip(sorted(wholes), packed + np.cumsum([0, *(wholes[k] for k in sorted(wholes))])))
    firsts = spark.sparkContext.broadcast(ahead)
    ranked = rows.where(~full).withColumn("rank", F.row_number().over(Window.partitionBy("kind", "salt").orderBy("doc_id", "text_hash", "start")).cast("long") - 1)
    carry = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole sequences, in the order of the written partition that they are read from."""
        at: dict[int, int] = {}
        for b in batches:
            if b.num_rows:
                part = b.column("part")[0].as_py()  # a task reads one written partition
                first = at.setdefault(part, int(firsts.value[part]))
                at[part] += b.num_rows
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(np.arange(first, first + b.num_rows)), pa.array(np.zeros(b.num_rows, np.int64))], names=[*carry, "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for b in batches:
            k = b.column("kind").to_numpy()
            sequence, slot = place(p, k, p.before[k, b.column("salt").to_numpy()] + b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(sequence), pa.array(slot)], names=[*carry, "sequence_id", "slot"])

    placed = ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    parts = placed.select(*carry, "sequence_id", F.coalesce(before, F.lit(0)).cast("long").alias("offset"))
    whole = rows.where(full).mapInArrow(number, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return parts.unionByName(whole)
