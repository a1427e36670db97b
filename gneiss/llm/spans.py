"""SentencePiece encoding that keeps offsets, and decoding.

Normalisation is done here: the longest prefix that the model's compiled character map knows is replaced,
and every byte of the result remembers the byte of the source that it came from. The library then cuts
normalised text with a copy of the model whose own normaliser is off, so that it changes nothing more.
Each piece's bytes are projected through the alignment to its bytes in the original text.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gneiss.session import ship

MARK = "▁"
BYTE_PIECE, UNKNOWN_PIECE = 6, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, raw bytes) of a protocol buffer message's fields."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        begin = at
        key, at = number(at)
        kind = key & 7
        value: int | bytes
        if kind == 0:
            value, at = number(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = number(at)
            value = data[at : at + size]
            at += size
        yield key >> 3, value, data[begin:at]


class CharMap:
    """The compiled character map: a double-array trie from byte strings to their replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.texts = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """The replacement of the longest known prefix at a place, and its length; else the character itself."""
        found, length = -1, 0
        if self.units:
            step = lambda u: (u >> 10) << ((u & 512) >> 6)
            node = step(self.units[0])
            for n in range(at, len(data)):
                node ^= data[n]
                if node >= len(self.units):
                    break
                unit = self.units[node]
                if unit & 0x800000FF != data[n]:
                    break
                node ^= step(unit)
                if unit >> 8 & 1:
                    found, length = self.units[node] & 0x7FFFFFFF, n + 1 - at
        if length:
            return self.texts[found : self.texts.index(b"\0", found)], length
        size = 1 if data[at] < 0xC0 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return data[at : at + size], size


@dataclass
class Encoding:
    """A text's ids and, for each piece, the bytes begin .. end of the original text in UTF-8."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray


class SpanEncoder:
    """Encodes and decodes with one model file."""

    def __init__(self, path: str):
        data = open(path, "rb").read()
        rest, pieces, norm = [], [], {}
        for n, value, raw in fields(data):
            if n == 3:
                norm = {k: v for k, v, _ in fields(value)}
            else:
                rest.append(raw)
            if n == 1:
                pieces.append({k: v for k, v, _ in fields(value)})
        self.map = CharMap(norm.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        off = b"\x18\x00\x20\x00\x28\x00"  # no prefix, no removal, no escape
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=b"".join(rest) + b"\x1a" + bytes([len(off)]) + off)
        kinds = [p.get(3, 1) for p in pieces]
        texts = [p[1].decode() for p in pieces]
        self.size = np.array([1 if k == BYTE_PIECE else 0 if k == UNKNOWN_PIECE else len(t.encode()) for k, t in zip(kinds, texts)], dtype=np.int32)
        self.unknown = {n for n, k in enumerate(kinds) if k == UNKNOWN_PIECE}
        self.simple = not self.map.units and self.prefix and not self.squeeze and self.escape

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and, for each of its bytes and its end, the place in the original bytes."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, dtype=np.int64)
        if self.simple:
            source = np.frombuffer(data, np.uint8)
            return MARK + text.replace(" ", MARK), np.concatenate([[0, 0, 0], np.repeat(np.arange(len(source)), np.where(source == 0x20, 3, 1)), [len(source)]])
        out, came = bytearray(), []
        space = (MARK if self.escape else " ").encode()
        at = 0

        def put(piece: bytes) -> None:
            for byte in piece:
                new = space if byte == 0x20 else bytes([byte])
                out.extend(new)
                came.extend([at] * len(new))

        if self.squeeze:
            while at < len(data):
                piece, n = self.map.longest(data, at)
                if piece != b" ":
                    break
                at += n
        if at == len(data):
            return "", np.zeros(1, dtype=np.int64)
        if self.prefix:
            put(b" ")
        after_space = self.squeeze
        while at < len(data):
            piece, n = self.map.longest(data, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                if self.squeeze:
                    piece = re.sub(rb"  +", b" ", piece)
                put(piece)
                after_space = self.squeeze and piece.endswith(b" ")
            at += n
        end = len(data)
        if self.squeeze:
            while out.endswith(space):
                end = came[-len(space)]
                del out[-len(space) :], came[-len(space) :]
        return out.decode("utf-8", "replace"), np.array([*came, end], dtype=np.int64)

    def encode(self, text: str | None) -> Encoding:
        normal, came = self.normalise(text or "")
        if not normal:
            return Encoding(np.zeros(0, np.int32), came[:0], came[:0])
        ids = self.cutter.encode(normal)
        if self.unknown.isdisjoint(ids):
            ids = np.array(ids, dtype=np.int32)
            sizes = self.size[ids]
        else:  # what an unknown piece covers is in the library's own result only
            sizes = np.array([len(p.surface.encode()) for p in self.cutter.encode(normal, return_type="proto").pieces])
            ids = np.array(ids, dtype=np.int32)
        ends = np.cumsum(sizes, dtype=np.int64)
        return Encoding(ids, came[ends - sizes], came[ends])

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist()) if len(ids) else ""


_made: dict[str, SpanEncoder] = {}


def span_encoder(path: str) -> SpanEncoder:
    """The worker's encoder for a model file."""
    if path not in _made:
        _made[path] = SpanEncoder(path)
    return _made[path]


def encoded(docs: DataFrame, model: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, ids, begins, ends (arrays of int) and decoded (string): a row for each row; no shuffle.

    Null counts as empty, with no ids and an empty decoded text. Repeated rows stay repeated.
    """
    extra = [StructField(c, ArrayType(IntegerType())) for c in ("ids", "begins", "ends")] + [StructField("decoded", StringType())]

    def rows(encoder: SpanEncoder, texts: list[str | None]) -> list[pa.Array]:
        found = [encoder.encode(t) for t in texts]
        lists = [pa.array([getattr(e, c) for e in found], pa.list_(pa.int32())) for c in ("ids", "begin", "end")]
        return [*lists, pa.array([encoder.decode(e.ids) for e in found], pa.string())]

    return encoded_as(docs, model, carry, extra, rows)


def encoded_as(docs: DataFrame, model: str, carry: tuple[str, ...], extra: list[StructField], rows) -> DataFrame:
    """``carry`` and the columns ``extra``, which ``rows(encoder, texts)`` makes of each batch's texts."""
    ship(docs.sparkSession)
    names = [*carry, *(f.name for f in extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = span_encoder(model)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *rows(encoder, part.column("_text").to_pylist())], names=names)

    src = docs.select(*carry, F.col("text").cast("string").alias("_text"))
    return src.mapInArrow(run, StructType([*(f for f in src.schema.fields if f.name != "_text"), *extra]))
