"""Embedding near-duplicates by a pivot-permutation index.

1. Reference points (pivots) are chosen from a bounded sample so that no two are near each other; a dense
   group therefore holds one or two of them, however large it is, and its members agree on the others.
2. A vector is described by its NEAREST pivots, in order of nearness. Two vectors with a link agree on
   most of them; a pair is a candidate if it shares SHARED pivots or more.
3. The inverted lists, by label and pivot, find those pairs: with pivots in one fixed order, rarest first,
   two vectors that share SHARED of NEAREST meet in the list of their first common pivot, which is among
   the first NEAREST - SHARED + 1 of both. So a vector goes to that many lists, and a pair counts in one.
4. Lists above CELL are dealt into pairs of chunks. In a cell, single precision finds near pairs, shared
   pivots are counted, and double precision decides pairs near the threshold. A cell returns each member's
   number of linked rows and a spanning forest of its links, never the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.components import connected_components
from gneiss.llm.simhash import _unite, cells_of, dealt
from gneiss.session import cut, ship

COSINE = 0.98
NEAREST, SHARED = 4, 2
#: Classes of equal vectors that pivots are chosen from, at most: those with the smallest hash.
SAMPLE = 8192
#: Pivots: one for each LIST classes of the largest label, within these bounds, and none within SPREAD of another.
LIST, LEAST, MOST, SPREAD = 64, 48, 1024, 0.9
#: Rows of a chunk of a large list, and of a block.
CELL = 4096
ROWS = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    scale = np.abs(v).max(axis=1, keepdims=True)
    v = v / np.where(scale > 0, scale, 1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` of the unit vectors ``sample``, in its order, none within SPREAD of one before; rarest as a nearest pivot first."""
    chosen: list[int] = []
    near = np.full(len(sample), -1.0)
    for k in range(len(sample)):
        if len(chosen) < most and near[k] < SPREAD:
            chosen.append(k)
            near = np.maximum(near, sample @ sample[k])
    pivots = sample[chosen]
    often = np.bincount(described(sample, pivots).ravel(), minlength=len(pivots))
    return pivots[np.argsort(often, kind="stable")]


def described(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(n, NEAREST or fewer) numbers of each unit vector's nearest pivots, nearest first."""
    return np.argsort(-(v @ pivots.T), axis=1, kind="stable")[:, :NEAREST].astype(np.int16)


def postings(v: np.ndarray, pivots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's nearest pivots in their fixed order, and how many of the first ones are its lists."""
    if pivots is None or not len(pivots):  # no pivot has this length: one list
        return np.zeros((len(v), 1), dtype=np.int16), 1
    own = np.sort(described(v, pivots), axis=1)
    return own, max(1, own.shape[1] - min(SHARED, own.shape[1]) + 1)


def link_cell(vectors: np.ndarray, weight: np.ndarray, chunk: np.ndarray, across: bool, own: np.ndarray, pivot: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows linked to each member, root of each) over a cell's pairs whose first common pivot is the list's; across: only over those of two chunks."""
    v = unit(vectors)
    short = v.astype(np.float32)
    slack = (v.shape[1] + 8) * 2.0**-23  # above the error of a product in single precision
    left = right = np.arange(len(v))
    if across:
        first = chunk == chunk.min()
        left, right = left[first], right[~first]
    linked, root = np.zeros(len(v), dtype=np.int64), np.arange(len(v))
    least = min(SHARED, own.shape[1])
    for at in range(0, len(left), ROWS):
        a = left[at : at + ROWS]
        b = right if across else right[at:]
        cos = short[a] @ short[b].T
        i, j = np.nonzero(cos >= COSINE - slack)
        if not across:
            i, j = i[j > i], j[j > i]  # b begins with a
        good = np.zeros(len(i), dtype=np.int8)  # common pivots
        early = np.zeros(len(i), dtype=bool)  # a common pivot before the list's
        x, y = own[a], own[b]
        for p in range(own.shape[1]):
            for q in range(own.shape[1]):
                same = x[i, p] == y[j, q]
                good += same
                early |= same & (x[i, p] < pivot)
        ok = (good >= least) & ~early
        i, j = i[ok], j[ok]
        ok = cos[i, j] >= COSINE + slack
        close = np.flatnonzero(~ok)
        ok[close] = np.einsum("ij,ij->i", v[a[i[close]]], v[b[j[close]]]) >= COSINE
        i, j = a[i[ok]], b[j[ok]]
        linked += np.bincount(i, weights=weight[j], minlength=len(v)).astype(np.int64)
        linked += np.bincount(j, weights=weight[i], minlength=len(v)).astype(np.int64)
        new = root[i] != root[j]
        _unite(root, i[new], j[new])
    while not np.array_equal(root[root], root):
        root = root[root]
    return linked, root


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id, kept for every row.

    Vectors that are null, empty, zero or hold null or non-finite numbers, and those of a null label, link
    with nothing: no links, their own id as component, kept. So do vectors of different length. Repeated rows are
    other vectors of the same class. Empty input gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    e = F.col("_v")
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind, exact = ("array<float>", np.float32) if single else ("array<double>", np.float64)  # the vectors' own numbers, in as few bytes as they take
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).cast("string").alias("_label"), F.col(vector_col).cast(kind).alias("_v"))
    sound = F.col("_label").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    # A class is known by its label and 128 bits of two hashes, so that no join carries vectors.
    rows = rows.withColumn("_sound", F.coalesce(sound, F.lit(False))).withColumns({"_a": F.xxhash64("_v", F.lit(1)), "_b": F.xxhash64(F.lit(2), "_v")})
    key = ["_label", "_a", "_b"]
    classes = rows.where("_sound").groupBy(*key).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.any_value("_v").alias("_v"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    largest = (classes.groupBy("_label").count().agg(F.max("count")).first()[0] or 0) // LIST
    sample: dict[int, list] = {}
    for r in classes.select("_v").orderBy(F.xxhash64("node")).limit(SAMPLE).toLocalIterator():
        sample.setdefault(len(r[0]), []).append(r[0])
    sent = spark.sparkContext.broadcast({dim: choose_pivots(unit(np.array(vs, dtype=np.float64)), min(max(largest, LEAST), MOST)) for dim, vs in sample.items()})  # at most SAMPLE vectors
    names = ["_label", "dim", "pivot", "node", "n", "own", "vector"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = b.column("_v")
            at, values = vs.offsets.to_numpy(), vs.values.to_numpy(zero_copy_only=False).astype(exact, copy=False)
            dims = np.diff(at)
            for dim in np.unique(dims):
                some = np.flatnonzero(dims == dim)
                v = values[(at[some][:, None] + np.arange(dim)).ravel()].reshape(len(some), dim)
                own, lists = postings(unit(v), sent.value.get(int(dim)))
                which = np.repeat(np.arange(len(some)), lists)
                rows = pa.array(some[which])
                raw, pivots = [x.tobytes() for x in v], [x.tobytes() for x in own]
                yield pa.RecordBatch.from_arrays(
                    [b.column("_label").take(rows), pa.array(np.full(len(which), dim, np.int32)), pa.array(own[:, :lists].ravel().astype(np.int32)), b.column("node").take(rows), b.column("_n").take(rows), pa.array([pivots[k] for k in which], pa.binary()), pa.array([raw[k] for k in which], pa.binary())], names=names
                )

    entries = classes.select("_label", "node", "_n", "_v").mapInArrow(listed, "_label string, dim int, pivot int, node long, n long, own binary, vector binary")
    entries = entries.withColumn("list_key", F.xxhash64("_label", "dim", "pivot"))
    cells = dealt(entries, "list_key", "node", CELL, few_large=True).select("list_key", "ci", "cj", *names, "chunk")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in cells_of(batches, ["list_key", "ci", "cj"]):
            kinds = t.group_by(["_label", "dim", "pivot"]).aggregate([])  # one, unless two lists' keys have the same hash
            for r in kinds.to_pylist():
                mine = t
                for k, x in r.items() if kinds.num_rows > 1 else ():
                    mine = mine.filter(pa.compute.field(k) == x)
                node = mine.column("node").to_numpy()
                v = np.frombuffer(b"".join(mine.column("vector").to_pylist()), exact).reshape(len(node), -1)
                own = np.frombuffer(b"".join(mine.column("own").to_pylist()), np.int16).reshape(len(node), -1)
                linked, root = link_cell(v, mine.column("n").to_numpy(), mine.column("chunk").to_numpy(), t.column("ci")[0].as_py() != t.column("cj")[0].as_py(), own, r["pivot"])
                some = np.flatnonzero(linked)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(linked[some])], names=["u", "v", "n"])

    found = cut(cells.repartition("list_key", "ci", "cj").sortWithinPartitions("list_key", "ci", "cj").mapInArrow(link, "u long, v long, n long"))
    members = connected_components(found.select("u", "v"))
    first = classes.select("node", "_first")
    roots = members.join(first, "node")
    low = roots.join(roots.groupBy("root").agg(F.min("_first").alias("_low")), "root").select("node", "_low")
    links = found.groupBy("u").agg(F.sum("n").alias("_links"))
    table = classes.select(*key, "_n", "_first", "node").join(links, F.col("node") == F.col("u"), "left").join(low, "node", "left")
    table = table.select(*(F.col(k).alias(f"{k}2") for k in key), (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links"), F.coalesce("_low", "_first").alias("_low"))
    ids = rows.select("_id", "_sound", *key)
    same = F.col("_sound") & (F.col("_label") == F.col("_label2")) & (F.col("_a") == F.col("_a2")) & (F.col("_b") == F.col("_b2"))
    out = ids.join(table, same, "left")
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_low", "_id").alias("component_id"), F.coalesce(F.col("_id") == F.coalesce("_low", "_id"), F.lit(True)).alias("kept")
    )
