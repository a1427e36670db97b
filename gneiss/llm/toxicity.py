"""Toxicity by a convolutional text classifier trained in numpy.

A text's letter runs, in lower case, are hashed into one table of embeddings: the run twice, against
collisions, and its stem once, which is its first five letters and how many follow. Filters of several
widths slide over the whole text, each keeps its maximum, and a logistic layer weighs the maxima. All
weights begin at random, and Adagrad trains them on every labelled text. A part of those that training
doesn't see calibrates the scores (Platt) and sets a threshold for each language. Languages are no input of
a score. Few labels are trained on at once; more are dealt into parts, which are trained on side by side
from the same weights and averaged after each pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gneiss.llm.frames import kept
from gneiss.session import settled, ship

BUCKETS = 1 << 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 4
#: Labelled rows, and words of theirs, that the driver trains on, at most; from more, tasks learn, each from about PART_ROWS rows a pass.
MAX_ROWS, MAX_WORDS = 5000, 20_000_000
PART_ROWS = 8000
EPOCHS, BATCH, RATE = 8, 32, 0.1
#: Buckets in fewer texts than this begin at zero.
MIN_TEXTS = 3
#: Every FOLD-th row calibrates and isn't trained on; the weight of other languages' rows in a language's threshold.
FOLD, OTHERS = 5, 0.1
#: predicted is 1 from this score on.
CUT = 0.3
STEM = 5
HASHES = 3
#: Steps of a logit in which calibration counts the rows of many parts.
STEPS = 256
#: Words of a batch of training, about, at most.
BATCH_WORDS = 1 << 20
#: Bytes of texts that are scored together, about.
TOGETHER = 2 << 20


def word_codes(words: list[str]) -> np.ndarray:
    """(n, HASHES) bucket numbers of words: the low and the high 18 bits of the word's hash, and its stem's."""
    crc = zlib.crc32
    h = np.fromiter((crc(x.encode()) for x in words), np.int64, len(words))
    stem = h.copy()
    long = [k for k, x in enumerate(words) if len(x) > STEM]
    stem[long] = [crc(f"{words[k][:STEM]}+{min(len(words[k]) - STEM, 3)}".encode()) for k in long]
    return np.stack([h & (BUCKETS - 1), h >> 14, (stem ^ 0x5BD1E995) & (BUCKETS - 1)], axis=1).astype(np.int32)


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket numbers of the different words, each word's place there, words of each text) of whole texts; null has none."""
    low = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\PL+", " "), " ")
    cut = pc.split_pattern(low, " ")
    coded = cut.flatten().dictionary_encode()
    counts = np.where(pc.binary_length(low).to_numpy(zero_copy_only=False) > 0, np.diff(cut.offsets.to_numpy()), 0)
    which, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if "" in words:  # what splitting an empty text gives
        which = which[which != words.index("")]
    return word_codes(words), which, counts


@dataclass
class Model:
    embed: np.ndarray
    filters: list[np.ndarray] = field(default_factory=list)
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(0))
    out_bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def slide(self, vectors: np.ndarray, which: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Each text's maxima, then what training needs: all filter outputs, the embeddings in order, and where each text begins.

        Texts lie one after the other with zero rows between them, so that no window holds words of two.
        """
        rows, pad = np.maximum(counts, 1), max(WIDTHS) - 1
        starts = np.concatenate([[0], np.cumsum(rows + pad)]).astype(np.int64)
        x = np.zeros((int(starts[-1]) + pad, DIM), dtype=np.float32)
        x[np.arange(len(which)) + np.repeat(starts[:-1] - (np.cumsum(counts) - counts), counts)] = vectors[which]
        n, outputs, tops = int(starts[-1]), [], []
        spans = np.stack([starts[:-1], starts[:-1] + rows], axis=1).ravel()
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            y = x[:n] @ f[0]
            for k in range(1, w):
                y += x[k : k + n] @ f[k]
            outputs.append(y)
            tops.append(np.maximum.reduceat(y, spans)[::2] + b)
        return np.concatenate(tops, axis=1), outputs, x, starts[:-1]

    def logits(self, texts: pa.Array) -> np.ndarray:
        codes, which, counts = hashed(texts)
        if not len(counts):
            return np.zeros(0)
        return np.maximum(self.slide(self.embed[codes].sum(axis=1), which, counts)[0], 0) @ self.out + self.out_bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A score for each text, rounded to six digits. Memory follows TOGETHER or the longest text: some 100 bytes a word."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        out, at = [np.zeros(0)], 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, side="right")))
            out.append(self.logits(texts.slice(at, upto - at)))
            at = upto
        a, b = self.scale
        return np.round(_sigmoid(a * np.concatenate(out) + b), 6)

    def score(self, text: str | None) -> float:
        return float(self.scores(pa.array([text], pa.string()))[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> tuple[float, float]:
    """Platt scaling with his smoothed targets: a >= 0.05, b. Each x counts ``times``, or once."""
    times = np.ones(len(x)) if times is None else times
    ones, zeros = (y * times).sum(), ((1 - y) * times).sum()
    hi, lo = (ones + 1) / (ones + 2), 1 / (zeros + 2)
    t = np.where(y > 0, hi, lo)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * x + b)
        w = (p * (1 - p) + 1e-6) * times
        g = np.array([((p - t) * x * times).sum() + 1e-3 * (a - 1), ((p - t) * times).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return (a, b) if a > 0.05 else (0.05, b)


def _best_cut(s: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap below the score that makes the weighted F1 largest."""
    order = np.argsort(-s, kind="stable")
    s, y, weight = s[order], y[order], weight[order]
    hits, taken = np.cumsum(y * weight), np.cumsum(weight)
    f1 = np.where(np.append(s[1:] != s[:-1], True), 2 * hits / (taken + hits[-1]), -1)
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


class _Steps:
    """Adagrad's memory by weight."""

    def __init__(self) -> None:
        self.seen: dict[tuple, np.ndarray | float] = {}

    def __call__(self, key: tuple, value, gradient):
        self.seen[key] = self.seen.get(key, 0.0) + gradient * gradient
        return value - RATE * gradient / (np.sqrt(self.seen[key]) + 1e-6)


def train(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], seed: int = 11, epochs: int = EPOCHS) -> Model:
    """A model from texts as (n, HASHES) bucket numbers. Deterministic. With one class or no rows, a constant score."""
    rng = np.random.default_rng(seed)
    n, y = len(texts), np.asarray(labels, dtype=np.float64)
    m = _begun(rng, n, float(y.sum()))
    if _constant(n, float(y.sum())):
        return m
    held = np.arange(n) % FOLD == FOLD - 1
    if y[held].sum() in (0, held.sum()) or y[~held].sum() in (0, (~held).sum()):
        held[:] = False
    own = np.flatnonzero(~held)
    known = np.flatnonzero(np.bincount(np.concatenate([np.unique(texts[k]) for k in own]), minlength=BUCKETS) >= MIN_TEXTS)
    m.embed[known] = rng.normal(0, 0.3 / np.sqrt(HASHES), (len(known), DIM))  # the others stay zero at first
    seen, step = np.zeros(BUCKETS, dtype=np.float32), _Steps()
    for _ in range(epochs):
        order = rng.permutation(own)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            _learn(m, [texts[k] for k in some], y[some], step, seen)
    fold = np.flatnonzero(held) if held.any() else own
    _calibrate(m, np.array([_logit(m, texts[k]) for k in fold]), y[fold], np.array([langs[k] or "" for k in fold]), np.ones(len(fold)))
    return m


def _constant(n: int, ones: float) -> bool:
    return n < 8 or ones in (0, n)


def _begun(rng: np.random.Generator, n: int, ones: float) -> Model:
    """Random weights before training on n rows, some of them toxic; embeddings are zero. From too few rows or one class, a constant score."""
    m = Model(np.zeros((BUCKETS, DIM), dtype=np.float32))
    m.filters = [rng.normal(0, 0.4 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    m.bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
    m.out = np.full(len(WIDTHS) * FILTERS, 0.5)
    if _constant(n, ones):
        rate = (ones + 0.5) / (n + 5)  # without labels a tenth, below CUT
        m.out[:], m.out_bias = 0, float(np.log(rate / (1 - rate)))
    else:
        rate = (ones + 0.5) / (n + 1)
        m.out_bias = float(np.log(rate / (1 - rate))) - 2  # maxima are above zero from the beginning
    return m


def _calibrate(m: Model, raw: np.ndarray, y: np.ndarray, langs: np.ndarray, times: np.ndarray) -> None:
    """Scale and thresholds from logits with their labels and languages ('': none), each counted ``times``."""
    m.scale = _logistic(raw, y, times)
    s = _sigmoid(m.scale[0] * raw + m.scale[1])
    m.thresholds[""] = _best_cut(s, y, times)
    for lang in sorted(set(langs) - {""}):
        m.thresholds[lang] = _best_cut(s, y, np.where(langs == lang, 1.0, OTHERS) * times)


def _logit(m: Model, codes: np.ndarray) -> float:
    top = m.slide(m.embed[codes].sum(axis=1), np.arange(len(codes)), np.array([len(codes)]))[0]
    return float(np.maximum(top[0], 0) @ m.out + m.out_bias)


def _learn(m: Model, texts: list[np.ndarray], y: np.ndarray, step: _Steps, seen: np.ndarray) -> None:
    """One step of the logistic loss over some texts; a maximum's gradient goes to its window only."""
    codes, counts = np.concatenate(texts), np.array([len(t) for t in texts])
    top, outputs, x, starts = m.slide(m.embed[codes].sum(axis=1), np.arange(len(codes)), counts)
    z = np.maximum(top, 0)
    err = _sigmoid(z @ m.out + m.out_bias) - y
    dz = (err[:, None] * m.out * (top > 0)).astype(np.float32)
    m.out = step(("out",), m.out, (err[:, None] * z).mean(axis=0) + 1e-5 * m.out)
    m.out_bias = float(step(("out_bias",), m.out_bias, err.mean()))
    rows, grads = [], []
    first = np.cumsum(counts) - counts
    for j, w in enumerate(WIDTHS):
        d = dz[:, j * FILTERS : (j + 1) * FILTERS]
        text, f = np.nonzero(d)
        if not len(text):
            continue
        # The window of each maximum, as rows of x.
        at = np.array([starts[t] + outputs[j][starts[t] : starts[t] + max(counts[t], 1), k].argmax() for t, k in zip(text, f)])
        window, slope = at[:, None] + np.arange(w), d[text, f][:, None, None]
        back = m.filters[j].transpose(2, 0, 1)[f] * slope
        own = np.zeros((FILTERS, w, DIM), dtype=np.float32)
        np.add.at(own, f, x[window] * slope)
        m.filters[j] = step(("filter", j), m.filters[j], own.transpose(1, 2, 0) / len(texts))
        m.bias[j] = step(("bias", j), m.bias[j], d.mean(axis=0))
        place = window - starts[text][:, None]
        inside = place < counts[text][:, None]
        rows.append(codes[(first[text][:, None] + place)[inside]])
        grads.append(back[inside])
    if rows:
        buckets = np.concatenate(rows)
        different, at = np.unique(buckets.ravel(), return_inverse=True)
        total = np.zeros((len(different), DIM), dtype=np.float32)
        np.add.at(total, at, np.repeat(np.concatenate(grads), HASHES, axis=0))
        seen[different] += (total * total).sum(axis=1)
        m.embed[different] -= 2 * RATE * total / (np.sqrt(seen[different]) + 1e-3)[:, None]


def _codes(words: np.ndarray) -> np.ndarray:
    """(n, HASHES) bucket numbers of words that are longs of 18 bits each."""
    return np.stack([(words >> (18 * k)) & (BUCKETS - 1) for k in range(HASHES)], axis=1).astype(np.int32)


def _texts(b: pa.RecordBatch) -> list[np.ndarray]:
    """The words of each row, as longs."""
    words = b.column("words")
    return np.split(words.flatten().to_numpy(), np.cumsum(pc.list_value_length(words).to_numpy())[:-1]) if b.num_rows else []


def _dense(m: Model, step: _Steps) -> tuple[np.ndarray, np.ndarray]:
    """Every weight but the embeddings in one vector, and Adagrad's memory of them in another."""
    keys = [("out",), ("out_bias",)] + [(n, j) for j in range(len(WIDTHS)) for n in ("filter", "bias")]
    values = [m.out, np.array([m.out_bias])] + [x for pair in zip(m.filters, m.bias) for x in pair]
    seen = [np.broadcast_to(step.seen.get(k, 0.0), np.shape(v)) for k, v in zip(keys, values)]
    flat = lambda xs: np.concatenate([np.ravel(x) for x in xs]).astype(np.float64)
    return flat(values), flat(seen)


def _undense(m: Model, step: _Steps, values: np.ndarray, seen: np.ndarray) -> None:
    """The reverse of ``_dense``."""
    shapes = [(("out",), m.out.shape), (("out_bias",), (1,))] + [x for j in range(len(WIDTHS)) for x in ((("filter", j), m.filters[j].shape), (("bias", j), m.bias[j].shape))]
    at = 0
    for key, shape in shapes:
        n = int(np.prod(shape))
        v, old = values[at : at + n].reshape(shape), seen[at : at + n].reshape(shape)
        at += n
        if key[0] == "out":
            m.out = v.copy()
        elif key[0] == "out_bias":
            m.out_bias, old = float(v[0]), float(old[0])
        else:
            (m.filters if key[0] == "filter" else m.bias)[key[1]] = v.astype(np.float32)
            old = old.astype(np.float32)
        step.seen[key] = old


#: What a part has changed: the embedding of a bucket, and the memory of its steps; or, under a negative number, DIM of the other weights.
CHANGE = "bucket int, " + ", ".join(f"v{k} float" for k in range(DIM)) + ", seen float"


def _part_changes(m: Model, step: _Steps, seen: np.ndarray, before: Model, before_step: _Steps, before_seen: np.ndarray) -> pa.RecordBatch:
    """What a part of the rows has changed, as CHANGE."""
    at = np.flatnonzero(seen != before_seen)
    dense = [(-len(v) % DIM, v - old) for v, old in zip(_dense(m, step), _dense(before, before_step))]
    dense = np.concatenate([np.pad(v, (0, pad)).reshape(-1, DIM) for pad, v in dense])
    buckets = np.concatenate([at, -1 - np.arange(len(dense))]).astype(np.int32)
    values = np.concatenate([m.embed[at] - before.embed[at], dense.astype(np.float32)])
    steps = np.concatenate([seen[at] - before_seen[at], np.zeros(len(dense), dtype=np.float32)])
    return pa.RecordBatch.from_arrays([pa.array(buckets), *(pa.array(values[:, k]) for k in range(DIM)), pa.array(steps)], names=["bucket", *(f"v{k}" for k in range(DIM)), "seen"])


def train_parts(rows: DataFrame, seed: int = 11, epochs: int = EPOCHS) -> Model:
    """A model from all of ``rows`` (part int, held boolean, toxic int, lang string, words array<long>), whose files hold a part each.

    A pass trains on every part from the same weights, in tasks that hold a batch at a time; what the parts
    have changed is averaged over those that changed it. The driver gets a row a bucket (BUCKETS at most) a
    pass, and of the fold that calibrates the counts of logits in steps of 1 / STEPS, so nothing that grows
    with the rows.
    """
    sc = rows.sparkSession.sparkContext
    one = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.when(F.col("held"), 1)), F.coalesce(F.sum(F.when(F.col("held"), F.col("toxic"))), F.lit(0))).first()
    n, ones, n_held, ones_held = (int(x) for x in one)
    rng = np.random.default_rng(seed)
    m = _begun(rng, n, ones)
    if _constant(n, ones):
        return m
    apart = ones_held not in (0, n_held) and ones - ones_held not in (0, n - n_held)
    own, fold = (rows.where("NOT held"), rows.where("held")) if apart else (rows, rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for t in _texts(b):
                total[np.unique(_codes(np.unique(t)))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    known = np.sort(own.select("words").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TEXTS).select("bucket").toPandas().bucket.to_numpy())
    m.embed[known] = rng.normal(0, 0.3 / np.sqrt(HASHES), (len(known), DIM))  # the others stay zero at first
    step, seen = _Steps(), np.zeros(BUCKETS, dtype=np.float32)
    for epoch in range(epochs):
        sent = sc.broadcast((m, step, seen))

        def learn(batches: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            before, before_step, before_seen = sent.value
            part, mine = None, None
            for b in batches:
                parts = b.column("part").to_numpy()
                for some in np.split(np.arange(len(parts)), np.flatnonzero(parts[1:] != parts[:-1]) + 1):
                    if not len(some):
                        continue
                    if parts[some[0]] != part:
                        if mine:
                            yield _part_changes(*mine[:3], before, before_step, before_seen)
                        part = int(parts[some[0]])
                        own_step = _Steps()
                        own_step.seen = dict(before_step.seen)
                        mine = (Model(before.embed.copy(), list(before.filters), list(before.bias), before.out, before.out_bias), own_step, before_seen.copy(), np.random.default_rng([seed, epoch, part]))
                    _pass(*mine, b.slice(int(some[0]), len(some)))
            if mine:
                yield _part_changes(*mine[:3], before, before_step, before_seen)

        mean = own.select("part", "toxic", "words").mapInArrow(learn, CHANGE).groupBy("bucket").agg(*(F.avg(c).cast("float").alias(c) for c in (*(f"v{k}" for k in range(DIM)), "seen"))).toPandas().sort_values("bucket")
        sent.destroy()
        values = mean[[f"v{k}" for k in range(DIM)]].to_numpy(dtype=np.float32)
        at = mean.bucket.to_numpy()
        here = at >= 0
        m.embed[at[here]] += values[here]
        seen[at[here]] += mean.seen.to_numpy(dtype=np.float32)[here]
        dense, memory = _dense(m, step)
        flat = values[~here][::-1].astype(np.float64).ravel()  # -1 is the first
        half = len(flat) // 2
        _undense(m, step, dense + flat[: len(dense)], memory + flat[half : half + len(memory)])
    sent = sc.broadcast(m)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.array([_logit(sent.value, _codes(t)) for t in _texts(b)])
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(raw, -30, 30) * STEPS).astype(np.int32)), b.column("toxic"), b.column("lang")], names=["at", "toxic", "lang"])

    got = fold.select("toxic", "lang", "words").mapInArrow(logits, "at int, toxic int, lang string").groupBy("at", "toxic", "lang").count().toPandas().sort_values(["at", "toxic", "lang"])
    _calibrate(m, got["at"].to_numpy() / STEPS, got.toxic.to_numpy().astype(np.float64), np.array([x if isinstance(x, str) else "" for x in got.lang]), got["count"].to_numpy().astype(np.float64))
    return m


def _pass(m: Model, step: _Steps, seen: np.ndarray, rng: np.random.Generator, b: pa.RecordBatch) -> None:
    """Training on the rows of ``b``, once, in random order."""
    words, y = _texts(b), b.column("toxic").to_numpy().astype(np.float64)
    some: list[int] = []
    total = 0
    for k in [*rng.permutation(len(words)).tolist(), None]:
        if some and (k is None or len(some) == BATCH or total + len(words[k]) > BATCH_WORDS):
            _learn(m, [_codes(words[x]) for x in some], y[some], step, seen)
            some, total = [], 0
        if k is not None:
            some.append(k)
            total += len(words[k])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all rows of ``labels`` (doc_id, toxic) and their whole texts.

    Up to MAX_ROWS rows of MAX_WORDS words in all are trained on by the driver, so 160 MB at most; more are
    trained on by tasks (``train_parts``). Null ids and labels are left out; a repeated id has its largest
    label, and one of its texts. No or one-sided labels give a constant score.
    """
    ship(docs.sparkSession)
    given = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "toxic")
    some = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, which, counts = hashed(b.column("text"))
            long = (codes.astype(np.int64) << (18 * np.arange(HASHES))).sum(axis=1)[which] if len(which) else np.zeros(0, dtype=np.int64)
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(long))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), pc.greater(b.column("toxic").cast(pa.int32()), 0).cast(pa.int32()), b.column("lang"), words], names=["doc_id", "toxic", "lang", "words"])

    def words_of(both: DataFrame) -> DataFrame:
        one = F.min(F.when(F.col("found"), F.struct(F.crc32("text").alias("h"), "text", "lang"))).alias("one")  # of a repeated id one text
        each = both.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), one).where("toxic IS NOT NULL AND one IS NOT NULL")
        return each.select("doc_id", "one.text", "one.lang", "toxic").mapInArrow(run, "doc_id string, toxic int, lang string, words array<long>")

    name = F.xxhash64("doc_id")
    held = (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLD)) == FOLD - 1).alias("held")
    n = some.count()
    texts = rows.where("doc_id IS NOT NULL").withColumn("found", F.lit(True))
    if n > MAX_ROWS:
        # One exchange of texts and labels together: Spark deals the two sides of a join anew, into as many
        # partitions as the session has, where those are more; parts would then be smaller and more.
        parts = -(-n // PART_ROWS)
        dealt = words_of(texts.unionByName(given, allowMissingColumns=True).repartition(parts, "doc_id"))
        return train_parts(settled(dealt.sortWithinPartitions(name).select(F.spark_partition_id().alias("part"), held, "toxic", "lang", "words")))
    words = settled(words_of(texts.join(F.broadcast(some), "doc_id")))  # MAX_ROWS bounds it
    total = words.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    if total > MAX_WORDS:
        parts = -(-total // MAX_WORDS)
        return train_parts(settled(words.repartition(int(parts), "doc_id").sortWithinPartitions(name).select(F.spark_partition_id().alias("part"), held, "toxic", "lang", "words")))
    got = words.toPandas().sort_values("doc_id", kind="stable")
    got = got.iloc[np.argsort([zlib.crc32(i.encode()[::-1]) for i in got.doc_id], kind="stable")]
    return train([_codes(np.asarray(w, dtype=np.int64)) for w in got.words], got.toxic.to_numpy().astype(int), [x if isinstance(x, str) else None for x in got.lang])


def scored(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, score, predicted (score >= CUT), threshold and flagged (score >= the language's threshold): a row for each row.

    Null and empty texts get the score of no words. A null or unknown language has the common threshold.
    Repeated rows stay. Only text and lang are read beside ``carry``, and lang only for the threshold.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), b.column("_lang"), pa.array(sent.value.scores(b.column("_text")))], names=[*carry, "_lang", "score"])

    src = docs.select(*carry, F.col("text").cast("string").alias("_text"), F.col("lang").cast("string").alias("_lang"))
    out = src.mapInArrow(run, StructType([*(f for f in src.schema.fields if f.name != "_text"), StructField("score", DoubleType())]))
    limit = F.lit(float(model.thresholds.get("", CUT)))
    for lang, t in sorted(model.thresholds.items()):
        limit = F.when(F.col("_lang") == lang, F.lit(float(t))).otherwise(limit) if lang else limit
    return out.withColumn("threshold", limit).withColumn("predicted", (F.col("score") >= CUT).cast("int")).withColumn("flagged", F.col("score") >= F.col("threshold")).drop("_lang")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted to be toxic, with the columns of ``docs``.

    Null and empty texts have the score of no words. Repeated rows stay or go together.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return kept(docs, "text", lambda texts: sent.value.scores(texts) < CUT)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, mod 4, is 2. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
