"""SimHash near-duplicates: pivot distance tables over Hamming space.

1. A text's fingerprint: 64 bits, one set where over half of its word 3-shingles' XXH64 have it set.
2. Equal fingerprints are one class, so copies cost one row from here on.
3. Two fingerprints with at most 3 differing bits agree in at least two of five bit blocks, so each
   class goes to ten lists, one for each pair of blocks. Lists of one are dropped by a count. Lists
   above CELL are dealt into chunks, and each pair of chunks is a cell of its own, so no task holds
   more than two chunks and none of the list's pairs is lost.
4. In a cell each fingerprint gets its row of the distance table: Hamming distances to reference
   fingerprints. By the triangle inequality a pair whose coordinates differ by more than 3 anywhere
   can't be a link. Sorting by the first coordinate leaves windows; the other coordinates then thin
   the pairs; XOR and a bit count verify those that are left.
5. A cell returns a spanning forest of its links, never all of them, and alternating stars find the
   components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.components import connected_components
from gneiss.llm.frames import positional
from gneiss.llm.words import words
from gneiss.session import cut, ship

SEED = 42
BITS = 3
#: First bit and width of each block; combinations of two blocks are the lists.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
LISTS = tuple(combinations(range(len(BLOCKS)), 2))
PIVOTS = 24
#: Rows of a chunk of a large list.
CELL = 4096
PAIRS = 1 << 20
#: Large lists that are few enough for a broadcast.
FEW = 50_000


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """The pivots, by rule: XXH64 of the numbers from 0."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", 7) for i in range(n)], dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 for null, empty or white space."""
    w = words(text)
    if not w:
        return 0
    w = [x.lower() for x in w]  # bytes.lower() changes A-Z only
    shingles = map(b" ".join, zip(w, w[1:], w[2:])) if len(w) >= 3 else [b" ".join(w)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 8192):
        part = np.ascontiguousarray(h[i : i + 8192].astype("<u8")).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, fp (the fingerprint as a signed long) and the columns in ``keep``, a row for each row."""
    ship(docs.sparkSession)
    cols = [id_col, *(c for c in keep if c not in (id_col, text_col))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column("_text")), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(fps.view(np.int64))], names=[*cols, "fp"])

    src = docs.select(*cols, F.col(text_col).cast("string").alias("_text"))
    fields = [f for f in src.schema.fields if f.name != "_text"]
    from pyspark.sql.types import LongType, StructField, StructType

    return src.mapInArrow(run, StructType([*fields, StructField("fp", LongType())]))


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of the pairs (i, j) in ``root``, where each entry points at or towards its smallest member."""
    while len(i):
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up
        a, b = root[i], root[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


def near_pairs(fp: np.ndarray, cell: np.ndarray, side: np.ndarray, tally: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of links within cells, in blocks of at most PAIRS pairs or those of one fingerprint.

    cell: a number for each fingerprint, ascending. side: -1 in cells whose pairs all count; in others 0 or
    1, and only pairs across count. tally, if given, gets added: pairs of all cells, those left by the
    first coordinate's windows, those left by all coordinates, links.
    """
    table = np.bitwise_count(fp[:, None] ^ reference_fingerprints()[None, :])
    first = cell.astype(np.int64) * 128 + table[:, 0]  # a distance is below 128, so windows never leave a cell
    order = np.argsort(first, kind="stable")
    first = first[order]
    starts = np.arange(len(fp)) + 1
    lens = np.searchsorted(first, first + BITS, side="right") - starts
    sums = np.concatenate([[0], np.cumsum(lens)])
    if tally is not None:
        n = np.bincount(cell)
        ones = np.bincount(cell, weights=side == 1, minlength=len(n)).astype(np.int64)
        tally[0] += int((np.where(np.bincount(cell, weights=side < 0, minlength=len(n)) > 0, n * (n - 1) // 2, ones * (n - ones))).sum())
    at = 0
    while at < len(fp):
        upto = max(at + 1, int(np.searchsorted(sums, sums[at] + PAIRS, side="right")) - 1)
        n = lens[at:upto]
        i = np.repeat(np.arange(at, upto), n)
        j = np.arange(len(i)) - np.repeat(sums[at:upto] - sums[at], n) + np.repeat(starts[at:upto], n)
        at = upto
        i, j = order[i], order[j]
        across = (side[i] != side[j]) | (side[i] < 0)
        i, j = i[across], j[across]
        if tally is not None:
            tally[1] += len(i)
        for p in range(1, table.shape[1]):  # the largest coordinate difference, one coordinate after the other
            a, b = table[i, p], table[j, p]
            fit = (np.maximum(a, b) - np.minimum(a, b)) <= BITS
            i, j = i[fit], j[fit]
        ok = np.bitwise_count(fp[i] ^ fp[j]) <= BITS
        if tally is not None:
            tally[2:] += len(i), int(ok.sum())
        yield i[ok], j[ok]


def link_cells(fp: np.ndarray, cell: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in cells, as (u, v) of signed fingerprints."""
    root = np.arange(len(fp))
    for i, j in near_pairs(fp.view(np.uint64), cell, side):
        _unite(root, i, j)
    while not np.array_equal(root[root], root):
        root = root[root]
    leaf = np.flatnonzero(root != np.arange(len(fp)))
    return fp[leaf], fp[root[leaf]]


def cells_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each cell with at least two, from batches that are sorted by the cell's keys."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        cols = [t.column(k).to_numpy() for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        bounds = np.concatenate([[0], new, [t.num_rows]])
        for s, e in zip(bounds[:-2], bounds[1:-1]):
            if e - s > 1:
                yield t.slice(s, e - s)
        rest = t.slice(bounds[-2])
    if rest is not None and rest.num_rows > 1:
        yield rest


def whole_cells(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows that hold whole cells only, and each row's cell as a number; from batches sorted by the cell's keys."""
    rest: list[pa.Table] = []
    size = 0

    def numbered(t: pa.Table) -> np.ndarray:
        cols = [t.column(k).to_numpy() for k in keys]
        return np.concatenate([[0], np.cumsum(np.any([c[1:] != c[:-1] for c in cols], axis=0))])

    for b in batches:
        if not b.num_rows:
            continue
        rest.append(pa.Table.from_batches([b]))
        size += b.num_rows
        if size >= rows:
            t = pa.concat_tables(rest).combine_chunks()
            n = numbered(t)
            if n[-1]:
                last = int(np.searchsorted(n, n[-1]))
                yield t.slice(0, last), n[:last]
                t = t.slice(last)
            rest, size = [t], t.num_rows
    if size:
        t = pa.concat_tables(rest).combine_chunks()
        yield t, numbered(t)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, cell in whole_cells(batches, ["list_key", "ci", "cj"], 4 * CELL):
        ci, cj, chunk = (t.column(c).to_numpy() for c in ("ci", "cj", "chunk"))
        u, v = link_cells(t.column("fp").to_numpy(), cell, np.where(ci == cj, -1, chunk == cj))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def dealt(rows: DataFrame, key: str, item: str, chunk_rows: int, few_large: bool = False) -> DataFrame:
    """``rows`` of every list with two or more, with the cells (ci, cj) that they go to.

    A list of up to chunk_rows is one cell. A larger one is split by the hash of ``item`` into chunks,
    and a row goes to the cells that pair its chunk with each chunk. few_large: for wide rows, where it
    pays to compute them twice: the large lists alone are looked up, by a broadcast if they are few, so
    that rows needn't be shuffled for it; lists of one then stay.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    found = rows.join(counts.where("_n > 1"), key) if not few_large else None
    if few_large:
        large = counts.where(F.col("_n") > chunk_rows).limit(FEW + 1).collect()
        if len(large) > FEW:
            return dealt(rows, key, item, chunk_rows)
        table = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in large], f"{key} long, _n long"))
        found = rows.join(table, key, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    g = F.ceil(F.col("_n") / chunk_rows).cast("int")
    j = F.col("_j")
    return (
        found
        .withColumn("_g", g)
        .withColumn("chunk", F.pmod(F.xxhash64(item), F.col("_g")).cast("int"))
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
        .withColumn("ci", F.least("chunk", j))
        .withColumn("cj", F.greatest("chunk", j))
        .drop("_n", "_g", "_j")
    )


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints in column fp that are within BITS of one another."""
    ship(fps.sparkSession)
    fp = F.col("fp")

    def part(k: int):
        at, width = BLOCKS[k]
        return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))

    keys = F.array(*[(F.lit(n << 26).bitwiseOR(F.shiftleft(part(a), 13)).bitwiseOR(part(b))).cast("long") for n, (a, b) in enumerate(LISTS)])
    rows = fps.select("fp", F.explode(keys).alias("list_key"))
    cells = dealt(rows, "list_key", "fp", CELL).select("list_key", "ci", "cj", "chunk", "fp")
    return cells.repartition("list_key", "ci", "cj").sortWithinPartitions("list_key", "ci", "cj").mapInArrow(_link, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, known: DataFrame | None = None) -> DataFrame:
    """id, fp (signed long), component_id (smallest id reachable) and group_fp (a fingerprint that names the group) for every row of ``docs``.

    Null, empty and white-space texts have fingerprint 0 and link like any other. Repeated rows stay
    repeated. A null id gets a component like the rest; components of null ids only have a null id.
    Empty input gives no rows. ``known``: rows of (id, fp) in place of fingerprints(docs).
    """
    ids = known if known is not None else cut(fingerprints(docs, id_col, text_col))
    classes = cut(ids.groupBy("fp").agg(F.min(id_col).alias("_first")))
    members = connected_components(fingerprint_links(classes))
    linked = members.join(classes, members.node == classes.fp).select("fp", "root", "_first")
    named = linked.groupBy("root").agg(F.min("_first").alias("_low"))
    # Cut, so that both sides of the last join are plain shuffles: only then AQE splits the rows of a fingerprint that a third of all texts share.
    low = cut(classes.join(linked.join(named, "root").select("fp", "root", "_low"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("group_fp"), F.coalesce("_low", "_first").alias("component_id")))
    return ids.join(low, "fp").select(*ids.columns, "component_id", "group_fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, its smallest id (ties: by the text's hash), with the columns of ``docs``.

    Null and empty texts are one group. Of a group whose ids are all null, one row stays. Empty input gives no rows.
    """
    rows = positional(docs)
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    rows = rows.withColumn("_hash", F.xxhash64(F.col(text).cast("string")))
    found = near_duplicates(rows, key, text, known=cut(fingerprints(rows.select(key, text, "_hash"), key, text, ("_hash",))))
    best = found.where(F.col(key).eqNullSafe(F.col("component_id"))).groupBy("group_fp").agg(F.min(F.struct(F.col(key).alias("id"), F.col("_hash").alias("hash"))).alias("b")).select("b.*").distinct()
    same = F.col(key).eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash"))
    return rows.join(best, same, "left_semi").dropDuplicates([key, "_hash"]).drop("_hash").toDF(*docs.columns)


def hex16(fp: str):
    """A fingerprint column as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
