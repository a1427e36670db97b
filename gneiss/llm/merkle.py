"""A Merkle manifest of a dataset, by an associative monoid of sparse forests.

Rows are leaves. The leaves of each group (by default: of each lang), in order of their key, form a tree of
ARITY children a node; the groups' roots, in order of the groups, form the upper tree.

1. Leaves are range-partitioned by group and key. One row a partition (its number of groups, and its first
   and last group with their counts) tells every partition the places of its leaves and the sizes of all
   trees that it shares with others.
2. A partition computes every node whose run of siblings is complete within it. What is left is its
   fragment: nodes keyed by tree, level and index, fewer than ARITY at either end of a level.
3. Fragments merge: nodes are put together, and whenever a run has as many members as the tree's size says,
   its parent replaces it. Merging is associative and commutative, so fragments are reduced as a tree,
   FAN of them a task in each round; a round writes the runs that it completed, for the proofs.
4. A partition gets the completed runs that lead from its leaves to the root, computes its own nodes again,
   and gives each leaf its proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from gneiss.session import cut, ship

ARITY = 8
#: Fragments that are merged by one task in a round.
FAN = 16
#: Rows of a range, at most about, and at least where there are fewer than the session's shuffle partitions.
MOST, LEAST = 262_144, 4_096
#: The tree over the groups' roots; the others are numbered from 0.
UPPER = -1
#: What is hashed of a row, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Node = tuple[int, int, int, int, bytes, int, int]  # tree, level, index, leaves of its tree, digest, first and last partition


def H(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def width(n: int, level: int) -> int:
    """Nodes of a level in a tree of n leaves."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


def merged(nodes: list[Node], groups: int) -> tuple[list[Node], list[tuple]]:
    """The nodes that remain when all complete runs are replaced by their parents, and those runs as (tree, level, run, digests, first, last partition).

    The product of the monoid: any bracketing and order of ``merged(a + b)`` leaves the same nodes. A
    group's root becomes a leaf of the upper tree, which has ``groups`` leaves; the root of that one stays.
    """
    waiting: dict[tuple[int, int, int], dict[int, Node]] = {}
    runs, left, work = [], [], list(nodes)
    while work:
        node = work.pop()
        tree, level, index, n, digest, first, last = node
        size = width(n, level)
        if size == 1:
            if tree == UPPER:
                left.append(node)
            else:
                work.append((UPPER, 0, tree, groups, digest, first, last))
            continue
        run = index // ARITY
        members = waiting.setdefault((tree, level, run), {})
        members[index] = node
        if len(members) == min(ARITY, size - run * ARITY):
            ordered = [members[k] for k in sorted(members)]
            digests = b"".join(m[4] for m in ordered)
            lo, hi = min(m[5] for m in ordered), max(m[6] for m in ordered)
            runs.append((tree, level, run, digests, lo, hi))
            work.append((tree, level + 1, run, n, H(digests), lo, hi))
            del waiting[tree, level, run]
    left += [m for members in waiting.values() for m in members.values()]
    return sorted(left), runs


class Local:
    """A partition's nodes in one tree: at each level the digests of a stretch of indexes, as far as they can be known here."""

    def __init__(self, n: int, first: int, digests: list[bytes]):
        self.n, self.first, self.digests, self.sizes = n, [first], [digests], [n]
        while self.sizes[-1] > 1 and self.digests[-1]:
            size, a, d = self.sizes[-1], self.first[-1], self.digests[-1]
            b = a + len(d)
            low = -(-a // ARITY)
            high = -(-size // ARITY) if b == size else b // ARITY
            self.digests.append([H(b"".join(d[max(0, r * ARITY - a) : r * ARITY - a + ARITY])) for r in range(low, max(low, high))])
            self.first.append(low)
            self.sizes.append(-(-size // ARITY))

    def run(self, level: int, run: int) -> bytes | None:
        """The digests of a run, if all of it is here."""
        if level >= len(self.digests):
            return None
        a, d = self.first[level], self.digests[level]
        lo, hi = run * ARITY, min(run * ARITY + ARITY, self.sizes[level])
        return b"".join(d[lo - a : hi - a]) if a <= lo and hi <= a + len(d) else None

    def unresolved(self, tree: int, pid: int) -> Iterator[Node]:
        """The nodes whose parent can't be known here, and the root if it is."""
        for level, (a, d) in enumerate(zip(self.first, self.digests)):
            inner = level + 1 < len(self.digests) and self.digests[level + 1]
            lo = self.first[level + 1] * ARITY if inner else a + len(d)
            hi = min((self.first[level + 1] + len(inner)) * ARITY, self.sizes[level]) if inner else a + len(d)
            for k in (*range(a, min(lo, a + len(d))), *range(max(hi, a), a + len(d))):
                yield tree, level, k, self.n, d[k - a], pid, pid


def leaves(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, text: str = "text") -> DataFrame:
    """id, group, leaf, tampered (null where nothing is), nth of every row."""

    def enc(c):
        s = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    def digest(changed):
        return F.sha2(F.concat(*(enc(changed if changed is not None and f == text else F.col(f)) for f in fields)).cast("binary"), 256)

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0
    return docs.select(F.col(key).alias("id"), F.col(group).cast("string").alias("group"), digest(None).alias("leaf"), F.when(hit, digest(F.translate(text, upper, upper.lower()))).alias("tampered"), F.monotonically_increasing_id().alias("nth"))


def _plan(ordered: DataFrame) -> tuple[dict[int, tuple[int, int, int, int]], int]:
    """partition -> (number of its first group, place of its first leaf there, leaves of its first and of its last group); number of groups. One row a partition comes to the driver."""
    counted = ordered.groupBy("pid", "group").agg(F.count("*").alias("n"))
    one = F.struct(F.col("group").isNotNull().alias("k"), "group", "n")
    ends = counted.groupBy("pid").agg(F.count("*").alias("groups"), F.min(one).alias("lo"), F.max(one).alias("hi"))
    rank, last, seen, found, total = -1, None, 0, [], {}
    for r in sorted(ends.collect(), key=lambda r: r.pid):
        if last is None or r.lo.group != last[0]:
            rank, seen = rank + 1, 0
        total[rank] = seen + r.lo.n
        end = rank + r.groups - 1
        if end > rank:
            total[end] = r.hi.n
        found.append((r.pid, rank, seen, end))
        seen, rank, last = total[end], end, (r.hi.group,)
    return {pid: (first, at, total[first], total[end]) for pid, first, at, end in found}, rank + 1


def _trees(groups: list, digests: list[bytes], plan: tuple[int, int, int, int], count: int) -> tuple[dict[int, Local], Local, np.ndarray]:
    """A partition's trees by number, its part of the upper tree, and the bounds of its groups' rows."""
    rank, at, first_n, last_n = plan
    bounds = [0, *(k for k in range(1, len(groups)) if groups[k] != groups[k - 1]), len(groups)]
    trees = {}
    for k, (s, e) in enumerate(zip(bounds, bounds[1:])):
        n = first_n if k == 0 else last_n if k == len(bounds) - 2 else e - s
        trees[rank + k] = Local(n, at if k == 0 else 0, digests[s:e])
    whole = [k for k, t in trees.items() if t.sizes[-1] == 1 and t.digests[-1]]
    return trees, Local(count, whole[0] if whole else 0, [trees[k].digests[-1][0] for k in whole]), np.array(bounds)


NODES = "kind string, part long, tree long, level int, idx long, n long, digest binary, lo long, hi long"


def _rows(part: int, nodes: list[Node], runs: list[tuple]) -> pa.Table:
    rows = [("node", part, t, level, k, n, d, lo, hi) for t, level, k, n, d, lo, hi in nodes] + [("run", part, t, level, k, 0, d, lo, hi) for t, level, k, d, lo, hi in runs]
    names, types = zip(*((c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in NODES.split(", ")))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(names), types)], names=list(names))


def _nodes(t: pa.Table) -> list[Node]:
    return list(zip(*(t.column(c).to_pylist() for c in ("tree", "level", "idx", "n", "digest", "lo", "hi"))))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, text: str = "text") -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified, and leaf_index, group_leaves, for every row of ``docs``.

    Nulls: a null field is hashed as ``-``; null groups are one, which comes first; null keys come first in
    their group and are not tampered with. Equal keys are ordered by their leaves, so that equal rows, whose
    leaves are equal, have neighbouring places and each its own proof. A group of one leaf has it as
    subroot. An empty table gives no rows. Columns other than ``fields`` do not count.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = cut(leaves(docs, key, group, fields, text))
    n = rows.count()
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST)), -(-n // MOST), 1)
    order = [F.asc_nulls_first("group"), F.asc_nulls_first("id"), F.asc("leaf"), F.asc("nth")]
    place = F.monotonically_increasing_id()  # of a sorted partition: its number and the row's
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "group", "leaf", "tampered", place.alias("place"))
    ordered = cut(ordered.withColumn("pid", F.shiftright("place", 33)))
    found, count = _plan(ordered)
    plans = spark.sparkContext.broadcast(found)  # four numbers a partition

    def fragment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        pid = t.column("pid")[0].as_py()
        trees, upper, _ = _trees(t.column("group").to_pylist(), [d.encode() for d in t.column("leaf").to_pylist()], plans.value[pid], count)
        left = [node for k, tree in trees.items() if tree.sizes[-1] > 1 or not tree.digests[-1] for node in tree.unresolved(k, pid)]
        yield from _rows(pid, left + list(upper.unresolved(UPPER, pid)), []).to_batches()

    def reduce(key: tuple, t: pa.Table) -> pa.Table:
        return _rows(key[0].as_py(), *merged(_nodes(t), count))

    level = cut(ordered.select("pid", "group", "leaf").mapInArrow(fragment, NODES))
    written, groups = [], max(found, default=0) + 1
    while groups > 1:
        done = cut(level.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(reduce, NODES))
        written.append(done.where("kind = 'run'"))
        level, groups = done.where("kind = 'node'"), -(-groups // FAN)
    top = level.collect()  # the root alone
    if n and (len(top) != 1 or top[0].tree != UPPER):
        raise RuntimeError(f"{len(top)} nodes are left in place of the root")
    root = bytes(top[0].digest) if n else b""
    runs = level.limit(0)
    for w in written:
        runs = runs.unionByName(w)
    runs = runs.select(F.explode(F.sequence("lo", "hi")).alias("pid"), "tree", "level", "idx", "digest")

    def prove(t: pa.Table, shared: pa.Table) -> pa.Table:
        if not t.num_rows:
            return out_schema(t).empty_table()
        t = t.sort_by("place")
        known = {(a, b, c): d for a, b, c, d in zip(*(shared.column(x).to_pylist() for x in ("tree", "level", "idx", "digest")))}
        plan = plans.value[t.column("pid")[0].as_py()]
        leaf = [d.encode() for d in t.column("leaf").to_pylist()]
        trees, upper, bounds = _trees(t.column("group").to_pylist(), leaf, plan, count)
        paths: dict[tuple[int, int, int], list[tuple[bytes, bytes]]] = {}

        def path(tree: int, level: int, index: int) -> list[tuple[bytes, bytes]]:
            """(digests before, digests after) of the node in its run, and so on up to the root."""
            local = upper if tree == UPPER else trees[tree]
            if width(local.n, level) == 1:
                return [] if tree == UPPER else path(UPPER, 0, tree)
            at = (tree, level, index)
            if at not in paths:
                run = local.run(level, index // ARITY) or known[tree, level, index // ARITY]
                k = index % ARITY * 64
                paths[at] = [(run[:k], run[k + 64 :]), *path(tree, level + 1, index // ARITY)]
                if level == 0 and tree != UPPER:
                    return paths.pop(at)  # asked for once
            return paths[at]

        subroots = {k: t.digests[-1][0] if t.sizes[-1] == 1 and t.digests[-1] else None for k, t in trees.items()}
        cols: list[list] = [[], [], [], [], []]
        for at, d in enumerate(t.column("tampered").to_pylist()):
            k = int(np.searchsorted(bounds, at, side="right")) - 1
            tree = plan[0] + k
            local = trees[tree]
            index = local.first[0] + at - int(bounds[k])
            steps = path(tree, 0, index)
            if subroots[tree] is None:
                own = leaf[at]
                for before, after in steps[: sum(1 for level in range(64) if width(local.n, level) > 1)]:
                    own = H(before + own + after)
                subroots[tree] = own
            now = d.encode() if d else leaf[at]
            for before, after in steps:
                now = H(before + now + after)
            for c, x in zip(cols, (subroots[tree].decode(), H(b"".join(b + a for b, a in steps)).decode(), now.decode(), now == root, (index, local.n))):
                c.append(x)
        places = cols.pop()
        data = [t.column("id"), t.column("leaf"), cols[0], [root.decode()] * t.num_rows, cols[1], cols[2], cols[3], [p[0] for p in places], [p[1] for p in places]]
        schema = out_schema(t)
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(data, schema)], schema=schema)

    def out_schema(t: pa.Table) -> pa.Schema:
        text = [(name, pa.string()) for name in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
        return pa.schema([("id", t.schema.field("id").type), *text, ("verified", pa.bool_()), ("leaf_index", pa.int64()), ("group_leaves", pa.int64())])

    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = StructType([StructField("id", rows.schema["id"].dataType), *(StructField(c, StringType()) for c in names), StructField("verified", BooleanType())]).add("leaf_index", "long").add("group_leaves", "long")
    proofs = ordered.groupBy("pid").cogroup(runs.groupBy("pid")).applyInArrow(prove, schema)
    return proofs.withColumnRenamed("id", key)


#: DuckDB SQL for the query's rows; crc32 by its polynomial over the digits of an id.
QUERY_SQL = """
WITH RECURSIVE base AS (
  SELECT doc_id, lang, leaf_of(text) AS leaf,
    CASE WHEN list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) IS NOT NULL
      AND xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 3 = 0
      THEN leaf_of(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS tampered
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM base
), lower_tree(lang, level, i, n, d) AS (
  SELECT lang, 0, i, n, leaf FROM placed
  UNION ALL
  SELECT lang, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM lower_tree WHERE n > 1 GROUP BY lang, level, i // 8, n
), sub AS (
  SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lower_tree WHERE n = 1
), upper_tree(level, i, n, d) AS (
  SELECT 0, i, n, subroot FROM sub
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM upper_tree WHERE n > 1 GROUP BY level, i // 8, n
), lower_side AS (
  SELECT lang, level, i, coalesce(string_agg(d, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(d, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
  FROM lower_tree WHERE n > 1 WINDOW run AS (PARTITION BY lang, level, i // 8 ORDER BY i)
), upper_side AS (
  SELECT level, i, coalesce(string_agg(d, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(d, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
  FROM upper_tree WHERE n > 1 WINDOW run AS (PARTITION BY level, i // 8 ORDER BY i)
), fold(lang, place, level, i, n, d, proof) AS (
  SELECT lang, i, 0, i, n, coalesce(tampered, leaf), '' FROM placed
  UNION ALL
  SELECT f.lang, f.place, f.level + 1, f.i // 8, (f.n + 7) // 8, sha256(s.b || f.d || s.a), f.proof || s.b || s.a
  FROM fold f JOIN lower_side s ON f.lang IS NOT DISTINCT FROM s.lang AND f.level = s.level AND f.i = s.i WHERE f.n > 1
), folded(lang, place, level, i, n, d, proof) AS (
  SELECT f.lang, f.place, 0, s.i, s.n, f.d, f.proof FROM fold f JOIN sub s ON f.lang IS NOT DISTINCT FROM s.lang WHERE f.n = 1
  UNION ALL
  SELECT f.lang, f.place, f.level + 1, f.i // 8, (f.n + 7) // 8, sha256(s.b || f.d || s.a), f.proof || s.b || s.a
  FROM folded f JOIN upper_side s ON f.level = s.level AND f.i = s.i WHERE f.n > 1
)
SELECT p.doc_id, p.leaf, s.subroot, r.d AS root, sha256(f.proof) AS proof_sha256, f.d AS folded_root, f.d = r.d AS verified, p.i::BIGINT AS leaf_index, p.n::BIGINT AS group_leaves
FROM placed p JOIN folded f ON p.lang IS NOT DISTINCT FROM f.lang AND p.i = f.place AND f.n = 1 JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang, upper_tree r WHERE r.n = 1
"""
_ENC = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END" for c in FIELDS)
for _call, _text in (("leaf_of(text)", "text"), ("leaf_of(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")):
    QUERY_SQL = QUERY_SQL.replace(_call, "sha256(" + _ENC.replace("text IS NULL", f"{_text} IS NULL").replace("text::VARCHAR", f"{_text}::VARCHAR") + ")")
