"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats, no rows and clashing columns."""

import gzip
import hashlib
import io
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gneiss.llm import arc, bytebpe, chat, components, embedding_dedup, langid, packing, quality, queries, simhash, spans, tokenfile, toxicity

BPE, PIECES = queries.BYTE_BPE, queries.PIECES
LONG = " ".join(f"w{k % 977}" for k in range(30_000))
TEXTS = [None, "", " \n\t", "one", "two words", "The quick brown fox jumps over the lazy dog near the river bank today", "the QUICK brown fox jumps over the lazy dog near the river bank today", "a  b\n\nc", "idiot's café 汉字 🚀 <|endoftext|> ▁x", LONG, "x\x00y z", "\n".join(["same line here"] * 9)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 2}", 0.5, "extra", 1) for k, t in enumerate(TEXTS)] + [(3, "one", None, None, None, None, None), (None, "no id", "de", "s", 1.0, "x", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, fp string, kept int")


def empty(df):
    return df.limit(0)


# --- components ---------------------------------------------------------------------------------------------------------


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 9), *((k, k + 1) for k in range(100, 140)), *((1000, k) for k in range(1001, 1200))]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {k: 100 for k in range(100, 141)} | {k: 1000 for k in range(1000, 1200)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 1 ------------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+".encode(), (text or "").encode())]
    if not w:
        return 0
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(fps):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprint():
    for t in TEXTS:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_simhash_spark_hash_is_the_same(spark):
    h = spark.createDataFrame([("ab cd é",)], "t string").select(F.xxhash64("t")).first()[0]
    assert h & (2**64 - 1) == xxhash.xxh64_intdigest("ab cd é".encode(), 42)


def test_simhash_groups(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    fps = [r.fp & (2**64 - 1) for r in got]
    root = groups(fps)
    for k, r in enumerate(got):
        ids = [x.doc_id for n, x in enumerate(got) if root[n] == root[k] and x.doc_id is not None]
        assert r.component_id == (min(ids) if ids else None)
    assert simhash.near_duplicates(empty(docs)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))


def test_simhash_cells_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))) for c in centres for _ in range(25)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    monkeypatch.setattr(simhash, "CELL", 7)  # so that lists are dealt into pairs of chunks
    got = simhash.near_duplicates(None, known=spark.createDataFrame([(k, f) for k, f in enumerate(signed)], "doc_id long, fp long"))
    root = groups([f & (2**64 - 1) for f in signed])
    low = {r: min(k for k in range(len(root)) if root[k] == r) for r in set(root)}
    assert {r.doc_id: r.component_id for r in got.collect()} == {k: low[r] for k, r in enumerate(root)}


def test_pivot_window_equals_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    f = np.unique(np.array([int(base) ^ sum(1 << int(b) for b in rng.integers(0, 64, 4)) for _ in range(600)], dtype=np.uint64))
    u, v = simhash.link_cells(f.view(np.int64), np.zeros(len(f), int), np.full(len(f), -1))
    root = groups([int(x) for x in f])
    assert len(u) == len(f) - len(set(root))


def test_pivots_decide_pairs_of_small_lists(spark):
    """At sf0.1, where no list has more than a few fingerprints, coordinate differences discard what isn't a link."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fps = np.unique(np.array([r.fp for r in simhash.fingerprints(docs).collect()], dtype=np.int64)).view(np.uint64)
    tally = np.zeros(4, dtype=np.int64)
    found = set()
    for n, (a, b) in enumerate(simhash.LISTS):
        key = np.zeros(len(fps), dtype=np.uint64)
        for at, width in (simhash.BLOCKS[a], simhash.BLOCKS[b]):
            key = key << np.uint64(width) | (fps >> np.uint64(at) & np.uint64((1 << width) - 1))
        order = np.argsort(key, kind="stable")
        cell = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        for i, j in simhash.near_pairs(fps[order], cell, np.full(len(fps), -1), tally):
            found |= {tuple(sorted((int(x), int(y)))) for x, y in zip(fps[order][i], fps[order][j])}
    want = set()
    for k, f in enumerate(fps):
        near = np.flatnonzero(np.bitwise_count(fps[k + 1 :] ^ f) <= 3) + k + 1
        want |= {tuple(sorted((int(f), int(fps[x])))) for x in near}
    pairs, windows, survivors, links = tally
    assert found == want and links >= len(want)
    assert pairs > windows > survivors >= links and survivors - links < 0.1 * (pairs - links)


# --- 2 ------------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    rows = []
    for k in range(600):
        words = [vocabulary[int(x)] for x in rng.integers(0, 400, 60)]
        bad = k % 5 == 0
        if bad:
            words[int(rng.integers(0, 60))] = "vilebeast" if k % 2 else "grimtoad"
        rows.append((k, " ".join(words), "en" if k % 3 else "fr", int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text", "lang"), df.select("doc_id", "toxic").where(~toxicity.held_out()))
    got = toxicity.scored(df, model, ("doc_id", "toxic")).withColumn("h", toxicity.held_out()).where("h").collect()
    assert np.mean([(r.score >= 0.3) == bool(r.toxic) for r in got]) > 0.95
    again = toxicity.fit(df.select("doc_id", "text", "lang"), df.select("doc_id", "toxic").where(~toxicity.held_out()))
    assert again.scale == model.scale and again.thresholds == model.thresholds


def test_toxicity_scores_equal_loops():
    """The forward pass by plain loops, for texts shorter than the widest filter too."""
    rng = np.random.default_rng(4)
    m = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32))
    m.filters = [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    m.bias = [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    m.out, m.out_bias, m.scale = rng.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS) * 0.1, 0.2, (0.3, 0.1)
    texts = ["one", "", None, "Two words, 3 Réally-long  ones", "zz " * 50, "unbelievable", "two WORDS"]
    for text, got in zip(texts, m.scores(pa.array(texts, pa.string()))):
        x = [m.embed[toxicity.word_codes([w])[0]].sum(axis=0) for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
        n = max(len(x), 1)
        x += [np.zeros(toxicity.DIM)] * (n + 2 - len(x))
        total = m.out_bias
        for j, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                top = max(sum(float(x[i + k] @ m.filters[j][k, :, f]) for k in range(w)) for i in range(n))
                total += max(top + m.bias[j][f], 0) * m.out[j * toxicity.FILTERS + f]
        assert abs(got - 1 / (1 + np.exp(-(0.3 * total + 0.1)))) < 1e-4


def test_toxicity_is_learnt_by_training():
    rng = np.random.default_rng(7)
    texts, labels = [], []
    for k in range(500):
        words = [f"w{chr(97 + x % 26)}{chr(97 + x // 26)}" for x in rng.integers(0, 400, 40).tolist()]
        if k % 4 == 0:
            words[int(rng.integers(0, 40))] = "vilebeast"
        texts.append(toxicity.word_codes(words))
        labels.append(int(k % 4 == 0))
    order = rng.permutation(500)
    texts, labels = [texts[k] for k in order], np.array(labels)[order]
    for epochs, right in ((0, lambda a: a < 0.7), (toxicity.EPOCHS, lambda a: a > 0.97)):
        m = toxicity.train(texts[:400], labels[:400], ["en"] * 400, epochs=epochs)
        s, y = np.array([toxicity._logit(m, t) for t in texts[400:]]), labels[400:]
        assert right(np.mean(s[y == 1][:, None] > s[y == 0][None, :]))
    assert set(m.thresholds) == {"", "en"}


def test_kept_rows_keep_odd_columns(spark, docs):
    odd = docs.select("doc_id", "text", "lang", F.col("source").alias("a.b"), F.col("score").alias("_row"), F.col("fp").alias("n words"), F.col("kept").alias("c0"))
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    for got in (quality.keep(odd), toxicity.keep(odd, model), simhash.keep_one(odd)):
        assert got.columns == odd.columns and 0 < got.count() <= odd.count() and got.schema.simpleString() == odd.schema.simpleString()


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.scored(empty(docs), toxicity.fit(docs, empty(labels))).count() == 0
    assert toxicity.keep(docs, model).columns == docs.columns


# --- 3 ------------------------------------------------------------------------------------------------------------------


def test_spans_equal_the_library():
    e, library = spans.SpanEncoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in [x or "" for x in TEXTS]:
        got, want = e.encode(t), library.encode(t, return_type="proto")
        assert got.ids.tolist() == [p.id for p in want.pieces]
        for p, begin, end in zip(want.pieces, got.begin, got.end):  # the library gives the bytes of a character to the last of its byte pieces
            assert (begin, end) == (p.begin, p.end) or re.fullmatch("<0x..>", p.piece) and end - begin == 1
        assert e.decode(got.ids) == library.decode(library.encode(t))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40))
def test_spans_of_any_text(text):
    e = spans.span_encoder(PIECES)
    got = e.encode(text)
    assert got.ids.tolist() == e.library.encode(text)
    assert int(np.sum(got.end - got.begin)) == len(text.encode())


def compiled_map(pairs):
    """A character map as models carry it: a double array in which every node has a block of 256 units of its own."""
    trie, texts, offsets = {}, b"", {}
    for k, v in pairs.items():
        offsets[k] = len(texts)
        texts += v + b"\0"
        node = trie
        for byte in k:
            node = node.setdefault(byte, {})
        node[None] = offsets[k]
    units, blocks = {0: 0}, [1]

    def place(node, at, label):
        base = blocks[0] << 8
        blocks[0] += 1
        units[at] = (at ^ base) << 10 | (256 if None in node else 0) | label
        if None in node:
            units[base] = 0x80000000 | node[None]
        for byte, child in node.items():
            if byte is not None:
                place(child, base ^ byte, byte)

    place(trie, 0, 0)
    array = [units.get(k, 0xFF) for k in range((blocks[0] + 1) << 8)]
    return struct.pack("<I", 4 * len(array)) + struct.pack(f"<{len(array)}I", *array) + texts


def test_character_map_longest_prefix_and_alignment():
    m = spans.CharMap(compiled_map({b"ab": b"X", b"abc": b"YZ", "ﬁ".encode(): b"fi", b"\t": b" "}))
    assert m.longest(b"abcd", 0) == (b"YZ", 3) and m.longest(b"abd", 0) == (b"X", 2) and m.longest(b"ad", 0) == (b"a", 1) and m.longest("é".encode(), 0) == ("é".encode(), 2)
    e = spans.SpanEncoder.__new__(spans.SpanEncoder)
    e.map, e.prefix, e.squeeze, e.escape, e.simple = m, True, True, True, False
    text, came = e.normalise("  abc \t ﬁx ")
    assert text == "▁YZ▁fix"
    assert came.tolist() == [2, 2, 2, 2, 2, 5, 5, 5, 8, 8, 11, 12]


def test_spans_frame(docs):
    got = spans.encoded(docs, PIECES, ("doc_id",)).collect()
    assert len(got) == docs.count() and [r for r in got if r.doc_id == 0][0].ids == []
    assert spans.encoded(empty(docs), PIECES).count() == 0


# --- 4 ------------------------------------------------------------------------------------------------------------------


def slow_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + d for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for d in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("text", TEXTS + ["a b c d e a b c d e", "x " * 50, "#1 *2 | <b>"])
def test_measures(text):
    assert quality.measure(text) == slow_measures(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeat_words(w):
    assert quality.measure(" ".join(w)) == slow_measures(" ".join(w))


def test_ledger_policies_and_ablations(docs):
    rows = quality.ledger(docs)
    got = {(r.doc_id, r.n_words): r for r in rows.withColumn("ok", quality.passes()).collect()}
    assert not got[(0, 0)].ok and got[(5, 14)].ok and not got[(11, 27)].ok
    bits = [r.rule_bits for r in rows.collect()]
    for r in quality.ablations(rows).collect():
        bit = 1 << list(quality.RULES).index(r.rule)
        assert (r.n_failed, r.n_only, r.n_docs) == (sum(b & bit > 0 for b in bits), sum(b & quality.mask() == bit for b in bits), len(bits))
    assert quality.keep(docs).columns == docs.columns and quality.ledger(empty(docs)).count() == 0


# --- 5 ------------------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.sampled_from([0, 50, 95, 100]))
def test_blocks_round_trip(ids, percentile):
    a = np.array(ids, dtype="<u4")
    assert np.array_equal(tokenfile.unpack_block(tokenfile.pack_block(a, percentile)), a)


def test_file_round_trip():
    out = io.BytesIO()
    out.close = lambda: None
    rng, w = np.random.default_rng(5), tokenfile.Writer(out)
    want = {k: rng.integers(0, 50_257, int(n)).astype("<u4") for k, n in enumerate(rng.integers(1, 9000, 30))}
    for k, ids in want.items():
        w.add(np.array([k]), np.array([False]), ids, np.array([len(ids)]))
    w.add(np.array([0]), np.array([True]), np.zeros(1, "<u4"), np.array([1]))
    size = w.close()
    data = out.getvalue()
    assert size == len(data)

    class Sized(io.BytesIO):
        def size(self):
            return len(data)

    r = tokenfile.Reader(Sized(data))
    got = [(None if n else int(k), t) for ids, null, _, ts in r.documents() for k, n, t in zip(ids, null, ts)]
    assert [k for k, _ in got] == [*want, None] and all(np.array_equal(t, want[k]) for k, t in got[:-1])
    assert len(data) < 0.62 * 4 * r.total


def slow_ids(text):
    return np.array(Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'’.é一"), st.characters(codec="utf-8")), max_size=30))
def test_encoder_equals_the_library(text):
    e = bytebpe.byte_bpe(BPE)
    assert e.encode(text).tolist() == e.tok.encode(text, add_special_tokens=False).ids


def test_encoder_batches(monkeypatch):
    texts = [*TEXTS, "a\tb  c\n\n d\r\n", "x\u00a0y", " lead", "trail ", "汉字かな Привет — “q”", "ª² ́", *TEXTS]
    e = bytebpe.ByteBPE(BPE)
    for together, call in ((1, 1), (100, 3), (1 << 22, 256)):
        monkeypatch.setattr(bytebpe, "TOGETHER", together)
        monkeypatch.setattr(bytebpe, "CALL", call)
        assert [x.tolist() for x in e.encode_all(texts)] == [e.tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(e.encode_all([])) == []


def test_token_files(docs):
    got = sorted(tokenfile.write_and_read(docs, BPE).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x) and len(got) == docs.count()
    at = 0
    for r in got:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id]
        want = slow_ids(text)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    assert tokenfile.write_and_read(empty(docs), BPE).count() == 0


# --- 6 ------------------------------------------------------------------------------------------------------------------


def test_language(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = langid.fit(d.where(~langid.held_out()))
    got = langid.identified(d, p, ("doc_id", "lang")).where(langid.held_out()).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert p.predict(None) == p.predict("") == p.predict("123 !?") == (langid.UNKNOWN, 0.0)
    assert p.predict("𐐀𐐁 𐐂")[0] in p.langs and p.predict("🚀 🚀") == (langid.UNKNOWN, 0.0)
    assert langid.fit(empty(d)).predict("text") == (langid.UNKNOWN, 0.0)


def slow_bundle(text):
    """By its definition: letters' random vectors, rolled by place, multiplied, summed."""
    letters = np.random.default_rng(5).integers(0, 2, (langid.LETTERS, langid.DIM)) * 2 - 1
    numbers, table = [0], langid.space().numbers
    for c in text:
        n = int(table[ord(c)]) if ord(c) < 0x10000 else 0
        if n or numbers[-1]:
            numbers.append(n)
    if numbers[-1]:
        numbers.append(0)
    return sum((np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(numbers, numbers[1:], numbers[2:])), np.zeros(langid.DIM))


def test_language_equals_brute_force(spark):
    texts = {"en": ["the quick brown fox", "a dog and the cat", "this is the way"], "de": ["der schnelle braune Fuchs", "ein Hund, die Katze!", "das ist über ß"], "xx": ["zzz qqq"]}
    rows = [(7, t, lang, None) for lang, ts in texts.items() for t in ts] + [(7, None, "en", None), (8, "12", "yy", None), (9, "no language", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    p = langid.fit(df)
    sums = {k: sum(slow_bundle(t) / np.linalg.norm(slow_bundle(t)) for t in ts) for k, ts in texts.items()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    m = unit(np.array([sums[k] for k in sorted(sums)]))
    m = unit(m - m.mean(axis=0))
    assert p.langs == ["de", "en", "xx"] and np.allclose(p.prototypes, m, atol=1e-5)
    probes = ["the dog", "Katze über", "é", "qqq " * 3000, "", None, "1 2"]
    asked = spark.createDataFrame([(k, t, "x", None) for k, t in enumerate(probes)] * 2, "doc_id long, text string, lang_pred string, score string")
    got = langid.identified(asked, p).collect()
    assert len(got) == 2 * len(probes) and langid.identified(asked.limit(0), p).count() == 0
    for r in got:
        t = probes[r.doc_id]
        v = slow_bundle(t or "")
        cos = m @ v / max(np.linalg.norm(v), 1e-9)
        assert r.lang_pred == (p.langs[int(cos.argmax())] if v.any() else "und") and abs(r.score - ((1 + cos.max()) / 2 if v.any() else 0)) < 1e-5


@pytest.mark.parametrize("doc_id", range(7, 13))
def test_a_language_whose_rows_share_an_id_is_learnt(spark, monkeypatch, doc_id):
    monkeypatch.setattr(langid, "TEXTS", 2)
    df = spark.createDataFrame([(doc_id, f"same id {chr(97 + k % 26)}{chr(97 + k // 26)}", "en") for k in range(300)] + [(doc_id, "gleich", "de")] * 300, "doc_id long, text string, lang string")
    assert langid.fit(df).langs == ["de", "en"]


# --- 7 ------------------------------------------------------------------------------------------------------------------


def test_markers():
    assert [chat.marker(x)[0] for x in ("User: hi", "### Human: x", "<|assistant|>ok", "Bot: y", "[system] z", "Because: no", "plain")] == [2, 2, 3, 3, 1, 0, 0]


def test_chat_roles_of_held_out_lines(spark):
    lines = chat.transcript_lines(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet"))
    held_out = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 == 2
    got = chat.parse(lines.where(held_out), chat.fit(lines.where(~held_out)), ("role",)).collect()
    assert np.mean([r.role == r.role_pred for r in got]) > 0.9


def test_chat(spark, sf_dir):
    lines = chat.transcript_lines(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    model = chat.fit(lines)
    got = chat.parse(lines, model, ("role",)).collect()
    assert len(got) == lines.count()
    by = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.turn, r.line_no)):
        by.setdefault(r.conv_id, []).append(r)
    for rows in by.values():
        whole = "".join(r.rendered for r in rows)
        assert whole.count("<|end|>\n") == sum(r.begins for r in rows) and rows[0].begins
    assert chat.parse(empty(lines), model).count() == 0


def test_decoding_equals_all_paths():
    """Viterbi against every path, by plain sums."""
    from itertools import product

    rng = np.random.default_rng(9)
    model = chat.Model(rng.random(6) * 5, rng.random((6, 6)) * 5, rng.random((6, chat.SYMBOLS)) * 5)
    for n in (1, 2, 5):
        for _ in range(4):
            seen = rng.integers(0, chat.SYMBOLS, n)
            score = lambda p: model.start[p[0]] + sum(model.shown[s, x] for s, x in zip(p, seen)) + sum(model.step[a, b] for a, b in zip(p, p[1:]))
            assert tuple(model.decode(seen)) == max(product(range(6), repeat=n), key=score)
            best, _ = model.through(seen)
            assert np.isclose(best[6].max(), score(model.decode(seen)))


def test_chat_edges(spark):
    rows = [(1, 0, "user", "hi\nthere"), (1, 0, "user", "hi\nthere"), (1, 1, None, None), (1, None, "assistant", "x"), (None, 0, "nobody", ""), (2, 0, "system", "User: quoted")]
    talk = spark.createDataFrame([(*r, "clash", True) for r in rows], "conv_id long, turn long, role string, text string, rendered string, begins boolean")
    lines = chat.transcript_lines(talk)
    got = chat.parse(lines, chat.fit(lines)).collect()
    assert len(got) == 8 and all(r.role_pred in chat.ROLES for r in got)
    assert chat.parse(lines, chat.fit(empty(lines))).count() == 8


def test_one_long_transcript_equals_plain_viterbi(spark, sf_dir):
    lines = chat.transcript_lines(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    model = chat.fit(lines)
    one = lines.withColumn("turn", F.col("conv_id") * 100 + F.col("turn")).withColumn("conv_id", F.lit(None).cast("long"))
    rows = sorted(one.collect(), key=lambda r: (r.turn, r.line_no))
    want = [chat.ROLES[k // 2] for k in model.decode(np.array([chat.symbol(r.line) for r in rows]))]
    got = sorted(chat.parse(one, model).collect(), key=lambda r: (r.turn, r.line_no))
    assert [r.role_pred for r in got] == want


# --- 8 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(version):
    blocks = [arc.page_block("héllo\nhttp://x 0.0.0.0 20000101000000 text/html 3\n".encode()), b"", b"no http head", arc.page_block(b"")]
    f = io.BytesIO(arc.arc_header(version) + b"".join(arc.arc_record(version, f"http://h/{k} with space", "20010203040506", b) for k, b in enumerate(blocks)))
    info, *got = arc.parse_arc(f)
    head, said = next(arc.read_warc(io.BytesIO(arc.convert_info(info, arc.record_id(None)))))
    assert head["warc-type"] == "warcinfo" and head["warc-filename"] == "pages.arc" and f"ARC version {version}".encode() in said
    assert [(r.version, r.url, r.block) for r in got] == [(version, f"http://h/{k} with space", b) for k, b in enumerate(blocks)]
    assert [bytes(r.block[r.payload_at :]) for r in got] == [blocks[0].split(b"\r\n\r\n", 1)[1], b"", b"no http head", b""]
    out = b"".join(gzip.compress(arc.convert(r, arc.record_id(k), arc.record_id(-5) if k == 3 else None)) for k, r in enumerate(got))
    back = list(arc.read_warc(io.BytesIO(gzip.decompress(out))))
    assert [h["warc-type"] for h, _ in back] == ["response"] * 3 + ["revisit"] and back[0][0]["warc-date"] == "2001-02-03T04:05:06Z"
    assert [h.get("arc-result-code") for h, _ in back] == [None if version == 1 else "200"] * 4
    assert back[0][1] == blocks[0] and arc.number_of(back[3][0]["warc-refers-to"]) == -5


def test_arc_errors():
    for bad in (b"no archive", arc.arc_header(1) + b"http://x 1 2 text/html 99\nshort", arc.arc_header(1) + b"too few\n"):
        with pytest.raises(ValueError):
            list(arc.parse_arc(io.BytesIO(bad)))


@given(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)))
def test_record_ids(n):
    assert arc.number_of(f"<{arc.record_id(n)}>") == n


def test_archives(spark):
    rows = [(5, "http://a b\n", "same"), (3, "http://b", "same"), (9, None, None), (4, "u", ""), (7, "u", "long " * 50_000), (7, "u", "ü"), (None, "u", "same"), (-2, "u", "other")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload_digest string")
    got = {(r.page_id, r.payload_bytes): r for r in arc.write_and_read(pages).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        body = (html or "").encode()
        r = got[(page, len(body))]
        first = min(p for p, _, h in rows if (h or "") == (html or "") and p is not None)
        assert r.payload_digest == arc.digest(body) and (r.record_type, r.refers_to) == (("response", None) if page == first else ("revisit", first))
    assert arc.write_and_read(pages.limit(0)).count() == 0
    assert arc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39")


# --- 9 ------------------------------------------------------------------------------------------------------------------


def test_packing(spark, docs):
    got = packing.pack(docs, BPE).collect()
    by, used = {}, Counter()
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id]
        ids = slow_ids(text)
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        used[r.doc_id] += r.length
    assert sum(used.values()) == sum(len(slow_ids(t)) for t in [*TEXTS, "one", "no id"])
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.ROOM
    assert sorted(by) == list(range(len(by))) and packing.pack(empty(docs), BPE).count() == 0


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(8)
    room = packing.ROOM // packing.UNIT
    demand = np.bincount(rng.integers(1, room // 2 + 1, 20_000), minlength=room + 1)
    solved = packing.solve(demand, room)
    assert np.allclose(sum(v * a for a, v in solved), demand, atol=1e-4)
    assert sum(v for _, v in solved) <= 1.003 * (demand * np.arange(room + 1)).sum() / room
    counts = np.zeros((room + 1, packing.SALTS), dtype=np.int64)
    counts[:, 0] = demand
    plan = packing.make_plan(counts, room)
    kind = np.repeat(np.arange(room + 1), demand)
    sequence, slot = packing.place(plan, kind, np.concatenate([np.arange(n) for n in demand]))
    assert np.bincount(sequence, weights=kind).max() <= room and len({*zip(sequence.tolist(), slot.tolist())}) == len(kind)
    assert sequence.max() + 1 <= 1.01 * (demand * np.arange(room + 1)).sum() / room


@given(st.integers(1, 5000))
def test_cuts(n):
    c = packing.cuts(n)
    assert [s for s, _ in c] == np.cumsum([0, *(l for _, l in c)])[:-1].tolist() and sum(l for _, l in c) == n and all(0 < l <= 1024 and (l == 1024 or l <= 512) for _, l in c)


# --- 10 -----------------------------------------------------------------------------------------------------------------


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 40)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    rows = [(k, [float(x) for x in centres[k % 30] + rng.normal(size=16) * rng.choice([0.02, 0.06])], int(k % 2)) for k in range(400)]
    rows += [(k + 400, rows[0][1], 0) for k in range(50)]  # exact copies
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, rows[0][1], None), (904, [None] * 16, 0), (905, [1.0, 2.0], 0), (906, [], 0), (907, [1.0, 2.0], 0), (908, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, node int, n_links string")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    v = embedding_dedup.unit(np.array([r[1] for r in rows], dtype=np.float32))
    label = np.array([r[2] for r in rows])
    linked = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    found = sum(got[r[0]].n_links for r in rows)
    assert 0.9 * linked.sum() <= found <= linked.sum()
    for k, r in enumerate(rows):
        assert got[r[0]].n_links <= linked[k].sum() and got[r[0]].component_id <= r[0] and got[r[0]].kept == (got[r[0]].component_id == r[0])
    assert got[449].component_id == 0
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in (900, 901, 902, 903, 904, 906, 908))
    assert (got[905].n_links, got[907].component_id) == (1, 905)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [4096, 700])
def test_embeddings_in_a_large_group(spark, monkeypatch, cell):
    """Queries are the rows whose id is divisible by 50, against all rows; a third of the vectors are distinct near copies of one."""
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    rng = np.random.default_rng(6)
    v = embedding_dedup.unit(rng.normal(size=(9000, 64)))
    v[:3000] = embedding_dedup.unit(rng.normal(size=(1, 64))) + 0.135 * v[:3000]
    v[3000:4000] = v[4000:5000] + 0.18 * embedding_dedup.unit(rng.normal(size=(1000, 64)))  # pairs close to the threshold
    v = v.astype(np.float32)[rng.permutation(9000)]
    df = spark.createDataFrame([(k, x.tolist(), 0) for k, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    u = embedding_dedup.unit(v)
    expected = {k: int((u @ u[k] >= 0.98).sum()) - 1 for k in range(0, 9000, 50)}
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert all(got[k].n_links <= n for k, n in expected.items())
    assert sum(got[k].n_links for k in expected) >= 0.99 * sum(expected.values()) > 30_000
    pairs = [k for k, n in expected.items() if n == 1]
    assert len(pairs) > 20 and sum(got[k].n_links for k in pairs) >= 0.95 * len(pairs)
    assert len({got[k].component_id for k, n in expected.items() if n > 100}) == 1


def test_public_files_are_not_copied():
    assert public_tokenizers.path("byte_bpe_50k.json") == BPE and "gneiss" not in BPE


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(900):
        words = [f"w{chr(97 + x % 26)}{chr(97 + x // 26)}" for x in rng.integers(0, 400, 6000 if k % 10 == 8 else 40).tolist()]
        if k % 4 == 0:
            words[int(rng.integers(0, len(words)))] = "vilebeast" if k % 10 != 8 else "onlyinlongtexts"  # long texts alone have a word of their own
        rows.append((k, " ".join(words), ("en", "de", None)[k % 3], int(k % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    monkeypatch.setattr(toxicity, "MAX_ROWS", 60)
    monkeypatch.setattr(toxicity, "PART_ROWS", 400)
    seen, before = [], toxicity.train_parts
    monkeypatch.setattr(toxicity, "train_parts", lambda rows: seen.append((rows.count(), rows.agg({"part": "max"}).first()[0])) or before(rows))
    model = toxicity.fit(df.select("doc_id", "text", "lang"), df.select("doc_id", "toxic"))
    assert seen[0][0] == 900 and seen[0][1] >= 2 and set(model.thresholds) == {"", "en", "de"}
    got = {r.doc_id: r.score for r in toxicity.scored(df, model).collect()}
    assert np.mean([(got[k] >= 0.3) == bool(t) for k, _, _, t in rows]) > 0.95
    assert np.mean([got[k] >= 0.3 for k, _, _, t in rows if k % 10 == 8 and t]) > 0.3 > np.mean([got[k] >= 0.3 for k, _, _, t in rows if k % 10 == 8 and not t])
    none = toxicity.fit(df.select("doc_id", "text", "lang"), df.select("doc_id", F.lit(0).alias("toxic")))
    assert none.score("vilebeast") < 0.3 and none.thresholds == {}


def test_toxicity_parts_are_as_many_as_their_size_says(spark, monkeypatch):
    rows = [(k, f"{'vile' if k % 5 == 0 else 'kind'} word{k % 7}", "en", int(k % 5 == 0)) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    monkeypatch.setattr(toxicity, "MAX_ROWS", 60)
    monkeypatch.setattr(toxicity, "PART_ROWS", 400)
    monkeypatch.setattr(toxicity, "train_parts", lambda rows: rows)
    labels = df.where("doc_id % 2 = 0").select("doc_id", "toxic").union(spark.createDataFrame([(0, 0), (2, 1), (5000, 1), (None, 1), (6, None)], "doc_id long, toxic int"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = toxicity.fit(df.union(df).select("doc_id", "text", "lang"), labels).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.part for r in got} == {0, 1} and len(got) == 450  # 451 labels, of which one has no text
    assert sum(r.toxic for r in got) == 91 and {len(r.words) for r in got} == {2} and {r.lang for r in got} == {"en"}
