"""Hard negatives by a table of pivot distances.

1. A vector x of integers gets one more coordinate, sqrt(M^2 - |x|^2), where M is the largest length; an
   anchor q gets a zero. Then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest have the highest score.
2. Each row's distances to PIVOTS augmented vectors are stored with it. By the triangle inequality they
   bracket |q' - x'|, and so the score, between max |d(q', p) - d(x', p)| and min d(q', p) + d(x', p).
3. Anchors meet rows in cells, pairs of a chunk of anchors and a chunk of rows. In a cell, the wanted
   number of best lower bounds gives a floor; a row whose upper bound is below it, or whose bracket lies
   outside the asked scores, is discarded; the others are checked exactly. Each cell returns at most the
   wanted number of rows for each question, and a window takes the first of them over all cells.

The first pass finds each anchor's positives in cells of its label. The second asks, for each positive, for
the best rows of other labels with scores between a share of the positive's score and that score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from gneiss.session import cut, ship

#: Reference points; the rows that they are chosen from, those with the smallest hash.
PIVOTS, SAMPLE = 16, 2048
#: Rows and anchors of a cell, at most about; anchors that are compared at a time.
ROWS, ANCHORS, BLOCK = 8192, 4096, 128
#: What brackets are widened by, as a share of the largest lengths: far above the error of stored single precision.
SLACK = 1e-6
#: Products below this are exact in double precision; larger ones are counted in Python's integers.
EXACT = 2.0**53
LONG = 2**63 - 1


def augmented(v: np.ndarray, m: float) -> np.ndarray:
    """Rows with the coordinate that makes all of them as long as ``m``."""
    v = v.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(m * m - np.einsum("ij,ij->i", v, v), 0))[:, None]])


def choose_pivots(sample: np.ndarray, m: float, n: int = PIVOTS) -> np.ndarray:
    """At most ``n`` of the augmented rows, each the farthest from those before."""
    x = augmented(sample, m)
    chosen, far = [], np.full(len(x), np.inf)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        k = int(far.argmax())
        chosen.append(k)
        far = np.minimum(far, np.sqrt(((x - x[k]) ** 2).sum(axis=1)))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots) Euclidean distances of augmented rows."""
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of longs: longs, or Python integers where those could overflow."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(a.shape[1], 1)
    if most < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(object) @ b.T.astype(object)


class Chunk:
    """Rows of one length: places (order of ids, nulls last), labels, vectors, and for rows their stored distances."""

    def __init__(self, t: pa.Table, dim: int):
        self.node = t.column("node").to_numpy()
        self.label = np.asarray(t.column("label").to_pylist(), dtype=object)
        self.v = np.frombuffer(b"".join(t.column("v").to_pylist()), np.int64).reshape(t.num_rows, dim) if t.num_rows and dim else np.zeros((t.num_rows, dim), np.int64)
        self.far = np.frombuffer(b"".join(t.column("far").to_pylist()), np.float32).reshape(t.num_rows, -1).astype(np.float64) if "far" in t.column_names else None


def by_id(t: pa.Table) -> pa.Table:
    """Sorted by id, nulls last, equal ids by node: a row's place decides ties."""
    return t.sort_by([("id", "ascending"), ("node", "ascending")])


def brackets(q: np.ndarray, far: np.ndarray, pivots: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) possible score of each of the rows, whose stored distances are ``far``, for anchors ``q``."""
    q = q.astype(np.float64)
    square = np.einsum("ij,ij->i", q, q)
    own = distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
    near, wide = np.zeros((len(q), len(far))), np.full((len(q), len(far)), np.inf)
    for p in range(len(pivots)):
        a, b = own[:, p, None], far[None, :, p]
        np.maximum(near, np.abs(a - b), out=near)
        np.minimum(wide, a + b, out=wide)
    slack = SLACK * (m + np.sqrt(square))[:, None]
    near, wide = np.maximum(near - slack, 0), wide + slack
    top = (square + m * m)[:, None]
    return (top - wide * wide) / 2 - slack * slack, (top - near * near) / 2 + slack * slack


def first_of(score: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest scores of each row among ``ok``, ties by the smaller column."""
    i, j = np.nonzero(ok)
    s = score[i, j]
    if s.dtype == object:
        order = np.array(sorted(range(len(i)), key=lambda x: (i[x], -s[x], j[x])), dtype=np.int64)
    else:
        order = np.lexsort((j, -s, i))
    i, j = i[order], j[order]
    begins = np.searchsorted(i, np.arange(len(score)))
    some = np.arange(len(i)) - begins[i] < k
    return i[some], j[some]


def floors(lowest: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """The k-th best lower bound of each row among ``ok``; minus infinity where there are fewer."""
    if lowest.shape[1] < k:
        return np.full(len(lowest), -np.inf)
    return -np.partition(np.where(ok, -lowest, np.inf), k - 1, axis=1)[:, k - 1]


def positives_of(anchors: Chunk, rows: Chunk, pivots: np.ndarray, m: float, k: int, tally: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) of each anchor's best other rows, at most k each. tally, if given, gets added pairs and pairs that were checked."""
    out = []
    for at in range(0, len(anchors.v), BLOCK):
        q = anchors.v[at : at + BLOCK]
        lowest, highest = brackets(q, rows.far, pivots, m)
        ok = anchors.node[at : at + BLOCK, None] != rows.node[None, :]
        some = ok & (highest >= floors(lowest, ok, k)[:, None])
        if tally is not None:
            tally += int(ok.sum()), int(some.sum())
        cols = np.flatnonzero(some.any(axis=0))
        score = products(q, rows.v[cols])
        i, j = first_of(score, some[:, cols], k)
        out.append((at + i, cols[j], score[i, j]))
    return out


def negatives_of(anchors: Chunk, asked: list[list[int]], rows: Chunk, pivots: np.ndarray, m: float, k: int, least: int, tally: np.ndarray | None = None) -> list[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(anchor, number of its positive, row, score): the best rows of other labels between ``least`` % of a positive's score and that score, at most k each."""
    out = []
    for at in range(0, len(anchors.v), BLOCK):
        q = anchors.v[at : at + BLOCK]
        wanted = asked[at : at + BLOCK]
        lowest, highest = brackets(q, rows.far, pivots, m)
        other = anchors.label[at : at + BLOCK, None] != rows.label[None, :]
        some, parts = np.zeros(other.shape, bool), []
        for n in range(max(map(len, wanted), default=0)):
            has = np.array([len(w) > n for w in wanted])[:, None]
            top = np.array([w[n] if len(w) > n else 0 for w in wanted], dtype=object)[:, None]
            hi, lo = top.astype(np.float64), top.astype(np.float64) * (least / 100)
            room = 1e-9 * (np.abs(hi) + 1)
            may = other & has & (highest >= np.minimum(hi, lo) - room) & (lowest <= np.maximum(hi, lo) + room)
            sure = may & (lowest >= lo + room) & (highest <= hi - room)
            may &= highest >= floors(lowest, sure, k)[:, None]
            parts.append((n, top, may))
            some |= may
        if tally is not None:
            tally += int(other.sum()), int(some.sum())
        cols = np.flatnonzero(some.any(axis=0))
        score = products(q, rows.v[cols])
        wide = score.dtype == object or any(abs(s) > LONG // 200 for w in wanted for s in w)
        for n, top, may in parts:
            s, t = (score.astype(object), top) if wide else (score, top.astype(np.int64))
            i, j = first_of(score, may[:, cols] & (least * t <= 100 * s).astype(bool) & (s <= t).astype(bool), k)
            out.append((at + i, n, cols[j], score[i, j]))
    return out


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array([max(-LONG - 1, min(LONG, int(s))) for s in x] if x.dtype == object else x, pa.int64())


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, v (longs), anchor: the rows that take part, as the query's contract has them.

    Rows with a null label, a null vector, or a null or non-finite component are left out. Every id that 7
    divides has the next of ten labels. A component x is floor(256 * x). Anchors have ids that 100 divides;
    a row with a null id is none, and keeps its label.
    """
    e, i = F.col(vector_col), F.col(id_col)
    sound = F.col(label_col).isNotNull() & e.isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    label = F.when(i % 7 == 0, F.pmod(F.col(label_col) + 1, F.lit(10))).otherwise(F.col(label_col))
    return vectors.where(sound).select(i.alias("id"), label.alias("label"), F.transform(e, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"), F.coalesce(i % 100 == 0, F.lit(False)).alias("anchor"))


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, least: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has id, label (not null), v (array of longs without nulls) and anchor; other columns are
    ignored. Scores are integer inner products, ties go to the smaller id, a null id comes last. Vectors of
    different lengths have no score. Repeated rows are rows of their own, each an anchor if it says so. A
    score beyond a long is shown as the largest or smallest one, but compared in full within a cell. No
    rows, no anchors, or one label only give no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), "v", "anchor", F.size("v").alias("dim"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sizes = {r.dim: (r.m or 1.0, r.n, r.anchors) for r in rows.groupBy("dim").agg(F.max(length).alias("m"), F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors")).collect()}
    sample: dict[int, list] = {}
    for r in rows.select("dim", "v").orderBy(F.xxhash64("v")).limit(SAMPLE).toLocalIterator():
        sample.setdefault(r.dim, []).append(r.v)
    pivots = {dim: choose_pivots(np.array(v, dtype=np.float64).reshape(len(v), dim), sizes[dim][0]) for dim, v in sample.items()}
    known = spark.sparkContext.broadcast({dim: (sizes[dim][0], pivots.get(dim, np.zeros((0, dim + 1)))) for dim in sizes})  # SAMPLE vectors at most

    def stored(batches):
        for b in batches:
            at, values = b.column("v").offsets.to_numpy(), b.column("v").values.to_numpy()
            dims, v, far = b.column("dim").to_numpy(), [b""] * b.num_rows, [b""] * b.num_rows
            for dim in np.unique(dims):
                some = np.flatnonzero(dims == dim)
                x = values[(at[some][:, None] + np.arange(dim)).ravel()].reshape(len(some), dim)
                m, p = known.value[int(dim)]
                d = distances(augmented(x, m), p).astype(np.float32)
                for k, one, two in zip(some, x, d):
                    v[k], far[k] = one.tobytes(), two.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("node", "id", "label", "dim", "anchor")] + [pa.array(v, pa.binary()), pa.array(far, pa.binary())], names=["node", "id", "label", "dim", "anchor", "v", "far"])

    numbered = rows.withColumn("node", F.monotonically_increasing_id())
    table = cut(numbered.mapInArrow(stored, "node long, id long, label string, dim int, anchor boolean, v binary, far binary"))
    kinds = table.groupBy("label", "dim").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("a"))
    large = F.broadcast(cut(kinds.where((F.col("n") > ROWS) | (F.col("a") > ANCHORS))))  # at most a row for each ANCHORS rows

    def dealt(side: DataFrame, mine: Column, theirs: Column, name: str, other: str) -> DataFrame:
        """A row goes to a chunk of its side by its node, and with it to each chunk of the other side."""
        return side.withColumn(name, F.pmod(F.xxhash64("node"), mine).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), theirs.cast("int") - 1)))

    def chunks(n: Column, most: int) -> Column:
        return F.greatest(F.ceil(F.coalesce(n, F.lit(1)) / most), F.lit(1)).cast("long")

    same = table.join(large, ["label", "dim"], "left").withColumns({"gr": chunks(F.col("n"), ROWS), "ga": chunks(F.col("a"), ANCHORS)}).drop("n", "a")
    key = ["label", "dim", "ab", "rb"]
    anchors = dealt(same.where("anchor"), F.col("ga"), F.col("gr"), "ab", "rb").select(*key, "node", "id", "v").toDF(*key, "node", "id", "v")  # new attributes, as both sides come from one table
    others = dealt(same, F.col("gr"), F.col("ga"), "rb", "ab").select(*key, "node", "id", "v", "far")

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {c: [] for c in ("node", "positive_node", "positive_id", "score")}
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            m, p = known.value[dim]
            right = by_id(right)
            a, r, ids = Chunk(left, dim), Chunk(right, dim), right.column("id")
            for i, j, s in positives_of(a, r, p, m, positives):
                found["node"].append(pa.array(a.node[i]))
                found["positive_node"].append(pa.array(r.node[j]))
                found["positive_id"].append(ids.take(pa.array(j)).combine_chunks())
                found["score"].append(_longs(s))
        return pa.table({c: pa.chunked_array(x, pa.int64()) for c, x in found.items()})

    found = anchors.groupBy(*key).cogroup(others.groupBy(*key)).applyInArrow(find, "node long, positive_node long, positive_id long, score long")
    order = Window.partitionBy("node").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"), "positive_node")
    best = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives)
    wanted = cut(best.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "score", "positive_id"))).alias("asked")))  # at most ``positives`` each

    # Cells of all labels: the chunks of a length are counted on the driver, from one row a length.
    def by_dim(n: int, most: int) -> Column:
        expr = F.lit(1)
        for dim, x in sizes.items():
            count = -(-x[n] // most)
            if count > 1:
                expr = F.when(F.col("dim") == dim, F.lit(count)).otherwise(expr)
        return expr.cast("long")

    key = ["dim", "ab", "rb"]
    asked = table.where("anchor").join(wanted, "node")
    anchors = dealt(asked, by_dim(2, ANCHORS), by_dim(1, ROWS), "ab", "rb").select(*key, "node", "id", "label", "v", "asked").toDF(*key, "node", "id", "label", "v", "asked")
    others = dealt(table, by_dim(1, ROWS), by_dim(2, ANCHORS), "rb", "ab").select(*key, "node", "id", "label", "v", "far")
    schema = StructType([StructField(c, LongType()) for c in ("node", "anchor_id", "k", "positive_id", "positive_score", "negative_node", "negative_id", "negative_score")])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {f.name: [] for f in schema}
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            m, p = known.value[dim]
            right = by_id(right)
            a, r, ids = Chunk(left, dim), Chunk(right, dim), right.column("id")
            tops = left.column("asked").to_pylist()
            own = left.column("id").to_pylist()
            for i, n, j, s in negatives_of(a, [[x["score"] for x in w] for w in tops], r, p, m, negatives, least):
                picked = [tops[x][n] for x in i]
                found["node"].append(pa.array(a.node[i]))
                found["anchor_id"].append(pa.array([own[x] for x in i], pa.int64()))
                found["k"].append(pa.array([x["k"] for x in picked], pa.int64()))
                found["positive_id"].append(pa.array([x["positive_id"] for x in picked], pa.int64()))
                found["positive_score"].append(pa.array([x["score"] for x in picked], pa.int64()))
                found["negative_node"].append(pa.array(r.node[j]))
                found["negative_id"].append(ids.take(pa.array(j)).combine_chunks())
                found["negative_score"].append(_longs(s))
        return pa.table({c: pa.chunked_array(x, pa.int64()) for c, x in found.items()})

    found = anchors.groupBy(*key).cogroup(others.groupBy(*key)).applyInArrow(answer, schema)
    order = Window.partitionBy("node", "k").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_node")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: DuckDB SQL for the query's rows.
QUERY_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negatives AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""
