"""Strongly connected components by trimming and forward-backward colouring, all in DataFrames.

No round holds more rows than there are edges: there is no closure. A round trims nodes that nothing
imports or that import nothing, then colours every node by the largest node that reaches it. A component is
of one colour: colours of few edges are finished in tasks, each by itself. Nodes of the others are coloured by
the largest node of their colour that they reach, too; where both are the same, the node is of that node's component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.session import settled, ship

#: Edges that a task finishes together, at most: a round of Spark's would take longer. What is found is the same.
FEW = 4_000_000
#: Edges of the colours that are dealt to one task, about.
TASK_EDGES = 100_000


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, to be joined by a shuffle whatever its size: a table that is broadcast goes through the driver, and there are many joins."""
    return df.hint("merge")


def coloured(edges: DataFrame) -> DataFrame:
    """node, colour: the largest node from which each node of ``edges`` (s, t) is reached, itself included.

    Besides one edge a step, a node takes the colour of its colour, so that a chain of n nodes takes about
    log n steps. A node with many edges costs one row an edge; maxima are taken before the shuffle.
    """
    c = settled(edges.select(F.explode(F.array("s", "t")).alias("node")).distinct().withColumn("colour", F.col("node")))
    state = None
    while True:
        near = edges.join(shuffled(c.select(F.col("node").alias("s"), "colour")), "s").groupBy(F.col("t").alias("node")).agg(F.max("colour").alias("near"))
        c = settled(c.join(shuffled(near), "node", "left").select("node", F.greatest("colour", F.coalesce("near", "colour")).alias("colour")))
        far = c.select(F.col("node").alias("colour"), F.col("colour").alias("far"))
        c = settled(c.join(shuffled(far), "colour").select("node", F.greatest("colour", "far").alias("colour")))
        before, state = state, c.agg(F.sum(F.col("colour").cast("decimal(38,0)"))).first()[0]  # colours only grow
        if before == state:
            return c


def trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` without those that no cycle can use, as far as trimming pays: each round takes a tenth or more."""
    n = edges.count()
    while n:
        into, out = edges.select(F.col("t").alias("s")).distinct(), edges.select(F.col("s").alias("t")).distinct()
        edges = settled(edges.join(shuffled(into), "s", "left_semi").join(shuffled(out), "t", "left_semi").select("s", "t"))
        before, n = n, edges.count()
        if n > 0.9 * before:
            break
    return edges


def low_links(s: np.ndarray, t: np.ndarray) -> dict[int, int]:
    """The component of every node that shares one with others, by Tarjan's algorithm without recursion."""
    names, at = np.unique(np.concatenate([s, t]), return_inverse=True)
    a, b = at[: len(s)], at[len(s) :]
    order = np.argsort(a, kind="stable")
    out, begin = b[order].tolist(), np.searchsorted(a[order], np.arange(len(names) + 1)).tolist()
    seen, low, stacked, stack, found = [0] * len(names), [0] * len(names), [False] * len(names), [], {}
    count = 0
    for root in range(len(names)):
        if seen[root]:
            continue
        path = [(root, begin[root])]
        while path:
            v, k = path.pop()
            if k == begin[v]:
                count += 1
                seen[v] = low[v] = count
                stack.append(v)
                stacked[v] = True
            elif stacked[out[k - 1]]:
                low[v] = min(low[v], low[out[k - 1]])  # of a child that has returned, or of a node on the stack
            if k < begin[v + 1]:
                path.append((v, k + 1))
                if not seen[out[k]]:
                    path.append((out[k], begin[out[k]]))
            elif low[v] == seen[v]:
                members = []
                while not members or members[-1] != v:
                    members.append(stack.pop())
                    stacked[members[-1]] = False
                if len(members) > 1:
                    found |= {int(names[m]): int(names[v]) for m in members}
    return found


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of edges (s, t, colour) that are sorted by colour, of which none has more than FEW edges; as many colours at a time as have about so many together."""
    held, size = [], 0

    def found() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        links = low_links(t.column("s").to_numpy(), t.column("t").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (links.keys(), links.values())], names=["node", "mark"])

    for b in batches:
        colours = b.column("colour").to_numpy()
        last = int(np.searchsorted(colours, colours[-1])) if len(colours) else 0
        if size >= FEW // 2 and len(colours) and (last or colours[0] != held[-1].column("colour")[-1].as_py()):
            # what is held ends with a whole colour once this batch's first colours are added
            held.append(b.slice(0, last))
            yield found()
            held, size, b = [], 0, b.slice(last)
        if b.num_rows:
            held.append(b)
            size += b.num_rows
    if held:
        yield found()


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node on a cycle of ``edges``, which has longs s and t.

    A node with an edge to itself is on a cycle. Repeated edges count once; edges with a null end are left
    out. No edges, or no cycle, give no rows.
    """
    edges = edges.where("s IS NOT NULL AND t IS NOT NULL").select(F.col("s").cast("long").alias("s"), F.col("t").cast("long").alias("t"))
    # Nodes are called by their hash, which is one to one for longs: of nodes in random order, few are the largest of those that reach them, so that few rounds are needed whatever the graph.
    names = edges.select(F.explode(F.array("s", "t")).alias("name")).distinct().select(F.xxhash64("name").alias("node"), "name")
    edges = settled(edges.select(F.xxhash64("s").alias("s"), F.xxhash64("t").alias("t")).distinct())
    loops = settled(edges.where("s = t").select(F.col("s").alias("node"), F.col("s").alias("mark")))
    found, rest = loops.limit(0), settled(edges.where("s <> t"))
    while True:
        rest = trimmed(rest)
        n = rest.count()
        if n <= FEW:
            if n:
                ship(rest.sparkSession)
                found = found.unionByName(settled(rest.select("s", "t", F.lit(0).cast("long").alias("colour")).coalesce(1).mapInArrow(finished, "node long, mark long")))
            break
        forward = coloured(rest)
        ends = rest.join(shuffled(forward.select(F.col("node").alias("s"), F.col("colour").alias("cs"))), "s").join(shuffled(forward.select(F.col("node").alias("t"), F.col("colour").alias("ct"))), "t")
        inner = settled(ends.where("cs = ct").select("s", "t", F.col("cs").alias("colour")))
        large = settled(inner.groupBy("colour").count().where(F.col("count") > FEW).select("colour"))
        ship(rest.sparkSession)
        few = inner.join(shuffled(large), "colour", "left_anti").select("s", "t", "colour").repartition(-(-n // TASK_EDGES), "colour").sortWithinPartitions("colour")
        found = found.unionByName(settled(few.mapInArrow(finished, "node long, mark long")))
        if not large.head(1):
            break
        inner = settled(inner.join(shuffled(large), "colour", "left_semi").select("s", "t"))
        forward = forward.join(shuffled(large), "colour", "left_semi").select("node", "colour")
        back = coloured(inner.select(F.col("t").alias("s"), F.col("s").alias("t"))).withColumnRenamed("colour", "back")
        done = settled(forward.join(shuffled(back), "node").where("colour = back").select("node", F.col("colour").alias("mark")))
        found = found.unionByName(done)
        gone = done.select("node")
        rest = settled(inner.join(shuffled(gone.withColumnRenamed("node", "s")), "s", "left_anti").join(shuffled(gone.withColumnRenamed("node", "t")), "t", "left_anti").select("s", "t"))
    found = settled(found.unionByName(loops.join(shuffled(found.select("node")), "node", "left_anti")))
    called = found.join(shuffled(names), "node").select("mark", F.col("name").alias("node"))
    return called.join(shuffled(called.groupBy("mark").agg(F.min("node").alias("component"))), "mark").select("node", "component")
