"""Token-id files in patched frame-of-reference blocks.

A file: ``GPF1``; blocks; the footer; the footer's length (u64); ``GPF1``. A block covers BLOCK ids (the last one
fewer). It subtracts the block's minimum and packs what remains at the width that a percentile of its
values needs; wider values go to the block's exception list and leave zero in the packed part.

Block: count u32, minimum u32, width u8, exceptions u32, packed bits (little-endian), exception places
u32 each, exception values u32 each. Footer: numbers of blocks and documents (u64 each), the start of
each block in the file (u64), document ids (i64), whether an id is null (u8), ids before each document (u64).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import sharedfs
from gneiss.llm.bytebpe import byte_bpe, with_end
from gneiss.session import cut, shared_folder, ship

MAGIC = b"GPF1"
BLOCK = 2048
#: The share of a block's values, in percent, that the packed width has to hold.
PERCENTILE = 95
END_ID = 0
#: Ids that a reader decodes at a time, about.
SPAN = 1 << 19
HEAD = struct.Struct("<IIBI")


@lru_cache(maxsize=128)
def _layout(n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where n values of a width lie in 64-bit words: each one's word and shift, each word's first value, and the values that reach into the next word."""
    at = np.arange(n) * width
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    return word, shift, np.searchsorted(word, np.arange(word[-1] + 1)), np.flatnonzero((at & 63) + width > 64)


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block. Any unsigned 32-bit ids, at least one."""
    low = int(ids.min())
    d = (ids - np.uint32(low)).astype("<u4")
    k = min(len(d) - 1, int(len(d) * percentile / 100))
    width = int(np.partition(d, k)[k]).bit_length()
    odd = np.flatnonzero(d >> np.uint32(width)) if width < 32 else np.zeros(0, dtype=np.int64)
    values = d[odd]
    d[odd] = 0
    packed = b""
    if width:
        word, shift, first, over = _layout(len(d), width)
        wide = d.astype(np.uint64)
        words = np.append(np.add.reduceat(wide << shift, first), np.uint64(0))  # values share no bit, so that a sum joins them
        words[word[over] + 1] += wide[over] >> (np.uint64(64) - shift[over])
        packed = words.astype("<u8").tobytes()[: (len(d) * width + 7) // 8]
    return HEAD.pack(len(d), low, width, len(odd)) + packed + odd.astype("<u4").tobytes() + values.tobytes()


def unpack_block(data: bytes | memoryview, at: int = 0) -> np.ndarray:
    """The ids of the block at a place."""
    n, low, width, odd = HEAD.unpack_from(data, at)
    at += HEAD.size
    size = (n * width + 7) // 8
    d = np.zeros(n, dtype=np.uint32)
    if width:
        word, shift, _, over = _layout(n, width)
        words = np.frombuffer(bytes(data[at : at + size]) + bytes(-size % 8 + 8), dtype="<u8")
        wide = words[word] >> shift
        wide[over] |= words[word[over] + 1] << (np.uint64(64) - shift[over])
        d = (wide & np.uint64((1 << width) - 1)).astype(np.uint32)
    at += size
    d[np.frombuffer(data, "<u4", odd, at)] = np.frombuffer(data, "<u4", odd, at + 4 * odd)
    return d + np.uint32(low)


class Writer:
    """Appends documents to an open file."""

    def __init__(self, out, block: int = BLOCK):
        self.out, self.block = out, block
        self.rest: list[np.ndarray] = []
        self.waiting = 0
        self.n_ids = 0
        self.at = len(MAGIC)
        self.blocks: list[int] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_docs = 0
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, null: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents whose ids stand one after the other, counts of them each; a null document id counts as 0."""
        ends = self.n_ids + np.cumsum(counts)
        self.docs.append((np.where(null, 0, doc_ids), null, ends - counts))
        self.n_docs += len(counts)
        self.n_ids += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 16 * self.block:
            self._flush(self.block)

    def _flush(self, least: int) -> None:
        if not self.rest:
            return
        all_ids, at = np.concatenate(self.rest), 0
        while len(all_ids) - at >= max(least, 1):
            data = pack_block(all_ids[at : at + self.block])
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
            at += self.block
        self.rest, self.waiting = [all_ids[at:].copy()], max(0, len(all_ids) - at)

    def close(self) -> int:
        """Writes what is left and the footer; the file's size."""
        self._flush(1)
        ids, null, starts = (np.concatenate([np.zeros(0, t), *x]).astype(t) for t, x in zip(("<i8", np.uint8, "<u8"), zip(*self.docs) if self.docs else ((), (), ())))
        foot = struct.pack("<QQ", len(self.blocks), self.n_docs) + np.array(self.blocks, "<u8").tobytes() + ids.tobytes() + null.tobytes() + starts.tobytes()
        self.out.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
        self.out.close()
        return self.at + len(foot) + 8 + len(MAGIC)


class Reader:
    """Random access to the documents of a file."""

    def __init__(self, file, block: int = BLOCK):
        self.file, self.block = file, block
        size = file.size()
        (n,) = struct.unpack("<Q", self._bytes(size - 12, 8))
        foot = self._bytes(size - 12 - n, n)
        if self._bytes(0, 4) != MAGIC or self._bytes(size - 4, 4) != MAGIC:
            raise ValueError("not a token-id file")
        b, d = struct.unpack_from("<QQ", foot)
        at = 16
        self.blocks = np.append(np.frombuffer(foot, "<u8", b, at), np.uint64(size - 12 - n)).astype(np.int64)
        at += 8 * b
        self.ids = np.frombuffer(foot, "<i8", d, at)
        self.null = np.frombuffer(foot, np.uint8, d, at + 8 * d).astype(bool)
        self.starts = np.frombuffer(foot, "<u8", d, at + 9 * d).astype(np.int64)
        last = HEAD.unpack_from(self._bytes(int(self.blocks[-2]), HEAD.size))[0] if b else 0
        self.total = (b - 1) * block + last if b else 0

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n of the file, through the index of block starts."""
        if n <= 0:
            return np.zeros(0, "<u4")
        a, b = start // self.block, (start + n - 1) // self.block + 1
        base = int(self.blocks[a])
        data = self._bytes(base, int(self.blocks[b]) - base)
        ids = np.concatenate([unpack_block(data, int(self.blocks[k]) - base) for k in range(a, b)])
        return ids[start - a * self.block : start - a * self.block + n]

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Runs of (document ids, null flags, starts, ids of each), about SPAN ids a run."""
        ends = np.append(self.starts[1:], self.total)
        at = 0
        while at < len(self.ids):
            upto = max(at + 1, int(np.searchsorted(ends, self.starts[at] + SPAN, side="right")))
            base = int(self.starts[at])
            run = self.read(base, int(ends[upto - 1]) - base)
            yield self.ids[at:upto], self.null[at:upto], self.starts[at:upto], [run[s - base : e - base] for s, e in zip(self.starts[at:upto], ends[at:upto])]
            at = upto


def write(docs: DataFrame, vocabulary: str, folder: str) -> DataFrame:
    """Writes the ids of every text, each document's followed by END_ID, in ascending doc_id order; the manifest.

    The manifest has a row a file: shard (ascending with doc_id), path, n_docs, n_ids, n_bytes. Null texts
    count as empty; null ids come first; equal ids are ordered by their text's hash. A repeated attempt
    of a task writes another file, and only those of the manifest are read. Empty input writes no file.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encoder, writer, path = byte_bpe(vocabulary), None, f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.gpf"
        for b in batches:
            doc_ids, null = b.column("doc_id").fill_null(0).to_numpy(), b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            at = 0
            for ids, counts in encoder.encode_array(b.column("text")):
                writer = writer or Writer(sharedfs.create(path))
                upto = at + len(counts)
                writer.add(doc_ids[at:upto], null[at:upto], *with_end(ids, counts, END_ID))
                at = upto
        if writer is not None:
            size = writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": path, "n_docs": writer.n_docs, "n_ids": writer.n_ids, "n_bytes": size}])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Rows of one id, and even repeats of one row, are dealt to as many ranges as their number asks for.
    rows = rows.withColumns({"_h": F.xxhash64("text"), "_r": F.pmod(F.monotonically_increasing_id(), F.lit(4096))})
    order = ["doc_id", "_h", "_r"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return cut(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_ids long, n_bytes long"))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the manifest's files, from the files alone.

    start counts the ids of all documents before it: file totals, one row a file, are summed on the driver.
    """
    spark = manifest.sparkSession
    files, base = [], 0
    for f in sorted(manifest.collect(), key=lambda r: r.shard):
        files.append((f.path, base))
        base += f.n_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                with sharedfs.open_file(path) as f:
                    for ids, null, starts, tokens in Reader(f).documents():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, mask=null), pa.array(starts + first), pa.array([len(t) for t in tokens], pa.int64()), pa.array([zlib.crc32(np.ascontiguousarray(t, "<u4").tobytes()) for t in tokens], pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    listed = spark.createDataFrame(files, "path string, base long")
    return listed.repartition(max(1, len(files))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The documents of new files in the shared folder, as read back from them."""
    return read(write(docs, vocabulary, shared_folder(docs.sparkSession, "tokens")))
