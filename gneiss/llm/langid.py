"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds its letters': each is permuted
(rolled) by its place and they are multiplied. A text's vector bundles, that is adds, those of all its
trigrams of letters and word ends. A language's prototype bundles its training texts, each scaled to
length 1, and the mean of all prototypes, which every language shares, is taken off. The prediction is the
prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gneiss.session import ship

DIM = 1024
GRAM = 3
#: Letters have numbers below this, 0 being a word's end; rarer letters share numbers by hash.
LETTERS = 128
#: Texts of each language that are learnt from, about, where there are more; chosen by hash of id and text.
TEXTS = 1500
#: Languages whose table of shares is broadcast, at most; more are joined by a shuffle.
SMALL_TABLE = 10_000
#: Texts whose trigrams are bound together.
TOGETHER = 256
UNKNOWN = "und"


def letter_vectors(seed: int = 5) -> np.ndarray:
    """(LETTERS, DIM) of +1 and -1."""
    return np.random.default_rng(seed).integers(0, 2, (LETTERS, DIM)).astype(np.int8) * 2 - 1


def letter_numbers() -> np.ndarray:
    """A number for each character of the basic plane: 0 if it's no letter."""
    table = np.zeros(0x10000, dtype=np.int32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            o = ord(low) if len(low) == 1 else c
            table[c] = o - 0x60 if 0x61 <= o <= 0x7A else o - 0xDF + 27 if 0xDF <= o < 0x100 else 60 + (o * 2654435761 >> 7) % (LETTERS - 60)
    return table


class Space:
    """The vectors of trigrams, made when first met."""

    def __init__(self):
        v = letter_vectors()
        self.rolled = [np.roll(v, GRAM - 1 - k, axis=1) for k in range(GRAM)]
        self.numbers = letter_numbers()

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Different trigrams (as numbers) of a whole text and how often each occurs."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
        n = self.numbers[np.minimum(points, 0xFFFF)]
        far = points >= 0x10000  # of letters beyond the basic plane, few texts have any
        if far.any():
            n[far] = [60 + (int(p) * 2654435761 >> 7) % (LETTERS - 60) if chr(p).isalpha() else 0 for p in points[far]]
        n = np.concatenate([[0], n, [0]])
        keep = (n[1:] != 0) | (n[:-1] != 0)  # runs of other characters are one word end
        n = np.concatenate([n[:1], n[1:][keep]])
        if len(n) < GRAM:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        codes = (n[:-2] * LETTERS + n[1:-1]) * LETTERS + n[2:]
        if len(codes) > 1 << 16:
            counts = np.bincount(codes, minlength=1)
            found = np.flatnonzero(counts)
            return found, counts[found].astype(np.float64)
        found, counts = np.unique(codes, return_counts=True)
        return found, counts.astype(np.float64)

    def bind(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of trigrams."""
        return self.rolled[0][codes // (LETTERS * LETTERS)] * self.rolled[1][codes // LETTERS % LETTERS] * self.rolled[2][codes % LETTERS]

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """(n, DIM) bundles of texts: the sums of their trigrams' vectors, each as often as it occurs; zero without a letter.

        Different trigrams are bound once for all of these texts; memory is a vector of bytes for each, LETTERS ** GRAM at most.
        """
        grams = [self.grams(t) if t else (np.zeros(0, dtype=np.int64), np.zeros(0)) for t in texts]
        different, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(c for c, _ in grams)]), return_inverse=True)
        bound = np.concatenate([np.zeros((0, DIM), np.int8), *(self.bind(different[k : k + 4096]) for k in range(0, len(different), 4096))])
        out, begin = np.zeros((len(texts), DIM)), 0
        for row, (codes, counts) in enumerate(grams):
            own, weights = at[begin : begin + len(codes)], counts.astype(np.float32)
            begin += len(codes)
            for k in range(0, len(own), 4096):
                out[row] += weights[k : k + 4096] @ bound[own[k : k + 4096]].astype(np.float32)
        return out


_space: list[Space] = []


def space() -> Space:
    """The worker's vectors."""
    if not _space:
        _space.append(Space())
    return _space[0]


@dataclass
class Profiles:
    """Languages in order of name, and their unit prototypes without the mean."""

    langs: list[str]
    prototypes: np.ndarray

    def predict_all(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and (1 + cosine) / 2; UNKNOWN and 0 without a letter or a language."""
        named, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for at in range(0, len(texts) if self.langs else 0, TOGETHER):
            v = space().bundles(texts[at : at + TOGETHER])
            size = np.linalg.norm(v, axis=1)
            cos = v @ self.prototypes.T / np.maximum(size, 1e-9)[:, None]
            best = cos.argmax(axis=1)
            for k in np.flatnonzero(size > 0):
                named[at + k], scores[at + k] = self.langs[best[k]], np.clip((1 + cos[k, best[k]]) / 2, 0, 1)
        return named, scores

    def predict(self, text: str | None) -> tuple[str, float]:
        named, scores = self.predict_all([text])
        return named[0], float(scores[0])


def fit(docs: DataFrame) -> Profiles:
    """Prototypes from about TEXTS texts of each non-null lang, and from one at least. Executors bundle; the driver gets a sum for each language.

    Texts that are null or without a letter teach nothing. Texts are not shuffled: the share of each language
    is a small table. Rows that repeat an id differ by their text's hash; equal rows are taken or left together.
    """
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), text.alias("text"), F.pmod(F.xxhash64(F.col("doc_id"), text, F.lit(3)), F.lit(1_000_003)).alias("_u"))
    lettered = rows.where(F.col("text").rlike(r"\p{L}"))
    share = lettered.groupBy("lang").agg(F.count("*").alias("_n"), F.min("_u").alias("_least")).select("lang", F.greatest(F.lit(1_000_003) * TEXTS / F.col("_n"), F.col("_least") + 1).alias("_most"))
    small = share.limit(SMALL_TABLE + 1).collect()  # a row a language
    if len(small) <= SMALL_TABLE:
        share = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in small], "lang string, _most double"))
    some = lettered.join(share, "lang").where("_u < _most").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                v = space().bundles(part.column("text").to_pylist())
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                for lang, x in zip(part.column("lang").to_pylist(), v):
                    sums.setdefault(lang, np.zeros(DIM))[:] += x
        for lang, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM), pa.int32()), pa.array(np.round(x * 2**30).astype(np.int64))], names=["lang", "place", "total"])

    got = some.mapInArrow(run, "lang string, place int, total long").groupBy("lang", "place").agg(F.sum("total").alias("total")).toPandas()
    langs = sorted(set(got.lang))
    m = np.zeros((len(langs), DIM))
    m[[langs.index(x) for x in got.lang], got.place] = got.total
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    if len(langs) > 1:
        m -= m.mean(axis=0)
    return Profiles(langs, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9))


def identified(docs: DataFrame, profiles: Profiles, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, lang_pred and score: a row for each row; no shuffle. Repeated rows stay repeated."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                named, scores = p.predict_all(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(named, pa.string()), pa.array(scores)], names=[*carry, "lang_pred", "score"])

    src = docs.select(*carry, F.col("text").cast("string").alias("_text"))
    return src.mapInArrow(run, StructType([*(f for f in src.schema.fields if f.name != "_text"), StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learnt from: crc32 of the id as text, mod 3, is 1. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
