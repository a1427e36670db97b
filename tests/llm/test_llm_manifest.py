"""Hard negatives, the Merkle manifest and virtual slots against brute force, with nulls, ties, repeats, skew, no rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gneiss.llm import hard_negatives, merkle, sharding

# --- 11 -----------------------------------------------------------------------------------------------------------------


def slow_negatives(rows):
    """rows: (node, id, label, ints, anchor)."""
    last = lambda k: (k is None, k or 0)
    out = Counter()
    for a in (r for r in rows if r[4]):
        score = {r[0]: sum(x * y for x, y in zip(a[3], r[3])) for r in rows if len(r[3]) == len(a[3]) and r[0] != a[0]}
        others = [r for r in rows if r[0] in score]
        best = sorted((r for r in others if r[2] == a[2]), key=lambda r: (-score[r[0]], last(r[1]), r[0]))[:5]
        for p in best:
            top = score[p[0]]
            good = sorted((r for r in others if r[2] != a[2] and 80 * top <= 100 * score[r[0]] <= 100 * top), key=lambda r: (-score[r[0]], last(r[1]), r[0]))[:5]
            out.update((a[1], p[1], k, n[1], top, score[n[0]]) for k, n in enumerate(good, 1))
    return out


def mined(df):
    return Counter(tuple(r) for r in hard_negatives.mine(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


SCHEMA = "id long, label string, v array<long>, anchor boolean, node int, far double"


@pytest.mark.parametrize("cell", [(8192, 4096), (40, 7)])
def test_negatives_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(hard_negatives, "ROWS", cell[0])
    monkeypatch.setattr(hard_negatives, "ANCHORS", cell[1])
    rng = np.random.default_rng(3)
    rows = []
    for k in range(260):
        v = rng.integers(-40, 60, 6) if k % 3 else [9, 8, 7, 6, 5, 4]  # a third of all rows are one vector
        rows.append((k, "ab"[k % 2] if k % 5 else "hot", [int(x) for x in v], k % 9 == 0, 1, 0.0))
    rows += [rows[9], rows[18]]  # repeated rows, anchors too
    rows += [(None, "a", [1, 2, 3, 4, 5, 6], False, 1, 0.0), (None, "b", [1, 2, 3, 4, 5, 6], False, 1, 0.0), (500, "a", [1, 2], True, 1, 0.0), (501, "b", [1, 2], False, 1, 0.0), (502, "a", [2, 2], False, 1, 0.0)]
    rows += [(503, "a", [], True, 1, 0.0), (504, "a", [], False, 1, 0.0), (505, "b", [], False, 1, 0.0), (506, "b", [0, 0, 0, 0, 0, 0], True, 1, 0.0)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == slow_negatives([(n, *r[:4]) for n, r in enumerate(rows)])


def test_negatives_of_large_components(spark):
    big = 3_000_000_000
    rows = [(100, "a", [big, 1], True, 0, 0.0), (1, "a", [big // 2, 5], False, 0, 0.0), (2, "b", [big // 2, 4], False, 0, 0.0), (3, "b", [big // 2, 6], False, 0, 0.0), (4, "b", [1, 1], False, 0, 0.0)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == slow_negatives([(n, *r[:4]) for n, r in enumerate(rows)]) != Counter()


def test_negatives_without_rows_or_labels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert not mined(empty)
    assert not mined(spark.createDataFrame([(100, "a", [1, 2], True, 0, 0.0), (1, "a", [1, 1], False, 0, 0.0)], SCHEMA))
    assert not mined(spark.createDataFrame([(1, "a", [1, 2], False, 0, 0.0), (2, "b", [1, 1], False, 0, 0.0)], SCHEMA))


def test_prepared_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [0.5, -0.001], 3), (7, [1.0, 2.0], 9), (None, [1.0, 1.0], 2), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [None, 1.0], 1), (5, [1.0, 1.0], None), (700, [0.0, 0.0], 4)]
    got = {r.id: (r.label, r.v, r.anchor) for r in hard_negatives.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {100: (3, [128, -1], True), 7: (0, [256, 512], False), None: (2, [256, 256], False), 700: (5, [0, 0], True)}


def test_brackets_hold_every_score_and_discard():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24)) * 200
    x = np.floor(centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 24)) * 6).astype(np.int64)
    m = float(np.linalg.norm(x.astype(float), axis=1).max())
    pivots = hard_negatives.choose_pivots(x, m)
    far = hard_negatives.distances(hard_negatives.augmented(x, m), pivots).astype(np.float32).astype(np.float64)
    low, high = hard_negatives.brackets(x[:40], far, pivots, m)
    score = hard_negatives.products(x[:40], x)
    assert (low <= score).all() and (score <= high).all()
    floor = hard_negatives.floors(low, np.ones_like(low, bool), 5)
    assert ((high >= floor[:, None]).mean()) < 0.25  # rows in groups: most of them needn't be checked


# --- 12 -----------------------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""

    def leaf(r, text):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*r[:4], text)))

    def levels(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([sha("".join(found[-1][k : k + 8])) for k in range(0, len(found[-1]), 8)])
        return found

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    langs = defaultdict(list)
    for r in rows:
        now = leaf(r, r[4])
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        langs[r[2]].append(((r[0] is not None, r[0] or 0), now, leaf(r, None if r[4] is None else r[4].translate(lower)) if bad else now, r[0]))
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[1] for x in sorted(langs[g], key=lambda x: x[:2])]) for g in order}
    upper = levels([trees[g][-1][0] for g in order])
    out = Counter()
    for at, g in enumerate(order):
        for i, (_, now, tampered, doc_id) in enumerate(sorted(langs[g], key=lambda x: x[:2])):
            proof, d = [], tampered
            for tree, k in ((trees[g], i), (upper, at)):
                for nodes in tree[:-1]:
                    s = k // 8 * 8
                    proof += nodes[s:k] + nodes[k + 1 : s + 8]
                    d = sha("".join(nodes[s:k] + [d] + nodes[k + 1 : s + 8]))
                    k //= 8
            out[doc_id, now, trees[g][-1][0], upper[-1][0], sha("".join(proof)), d, d == upper[-1][0]] += 1
    return out


def told(df):
    return Counter(tuple(r) for r in merkle.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf int, pid string"


@pytest.mark.parametrize("least", [4096, 20])
def test_manifest_equals_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(merkle, "LEAST", least)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rng = random.Random(1)
        rows = [(k, f"s{k % 3}", rng.choice(["en", "en", "de", "é", None, "z"]), k, f"Text Ä {k % 50}", 1, "x") for k in range(700)]
        rows += [(800 + k, None, f"only-{k:02d}", None, None, 1, "x") for k in range(30)]  # groups of one
        rows += [(5, "s", "en", 5, "AbC", 1, "x")] * 300  # a hot row
        rows += [(None, "s", "en", 1, "", 1, "x"), (None, None, None, None, None, None, None), (-7, "s", "de", 1, "W" * 200_000, 1, "x")]
        got, expected = told(spark.createDataFrame(rows, DOCS).repartition(5)), slow_manifest([r[:5] for r in rows])
        assert got == expected
        assert {k[6] for k in got} == {True, False}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_small_manifests(spark):
    for rows in ([], [(1, "s", "en", 1, "A", 1, "x")], [(k, "s", "en", 1, "A", 1, "x") for k in range(9)], [(k, "s", f"l{k:02d}", 1, "A", 1, "x") for k in range(9)]):
        assert told(spark.createDataFrame(rows, DOCS)) == slow_manifest([r[:5] for r in rows])


@given(st.lists(st.integers(1, 90), min_size=1, max_size=12), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_fragments_merge_in_any_order(sizes, rng):
    """Any bracketing of any order of a forest's leaves gives the same root and the same runs."""
    nodes = [(t, 0, k, n, sha(f"{t}-{k}").encode(), k, k) for t, n in enumerate(sizes) for k in range(n)]
    whole, runs = merkle.merged(nodes, len(sizes))
    assert len(whole) == 1 and whole[0][0] == merkle.UPPER
    rng.shuffle(nodes)
    pieces, seen = [[x] for x in nodes], []
    while len(pieces) > 1:
        k = rng.randrange(len(pieces) - 1)
        left, new = merkle.merged(pieces[k] + pieces[k + 1], len(sizes))
        pieces[k : k + 2] = [left]
        seen += new
    left, new = merkle.merged(pieces[0], len(sizes))
    assert left == whole and sorted(seen + new) == sorted(runs)


# --- 13 -----------------------------------------------------------------------------------------------------------------


def test_virtual_slots(spark, tmp_path):
    texts = [None, "", "é" * 40, "x" * 5000, "same"]
    rows = [(k, texts[k % 5] if k % 2 else f"text number {k} " * (k % 40), 1, "x", 7) for k in range(4000)] + [(None, "no id", 1, "x", 7)] * 3
    rows += [(9, "hot", 1, "x", 7)] * 2000  # a third of all rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int, shard string, slot int")
    got = sharding.assigned(docs, 40, folder=str(tmp_path / "map")).collect()
    expected = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
    held, places = Counter(), defaultdict(list)
    for r in got:
        held[r.shard] += r["size"]
        places[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 40
    assert len(held) == 40 and max(held.values()) - min(held.values()) <= 5016  # one record
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(Counter(r.virtual_slot for r in got).values()) < 40  # the hot record is spread
    first, second = (sharding.load_map(spark, str(tmp_path / "map"), v) for v in (1, 2))
    assert first.count() == second.count() == sharding.SLOTS and sharding.load_map(spark, str(tmp_path / "map")).first().version == 2
    moved = first.select("vslot", F.col("shard").alias("old")).join(second, "vslot").where("old <> shard")
    assert moved.agg(F.sum("bytes")).first()[0] < sum(held.values()) / 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sharding.store_map(second, str(tmp_path / "map"))


def test_maps_grow_and_shrink(spark):
    totals = spark.range(512).select(F.col("id").cast("int").alias("vslot"), (F.col("id") * 37 % 101 + 20).alias("bytes"), F.lit(1).cast("long").alias("rows"))
    now = sharding.cut(sharding.rebalanced(sharding.cut(sharding.first_map(totals, 8)), 8))
    shards = lambda m: {r.vslot: r.shard for r in m.collect()}
    loads = lambda m: {r.shard: r.load for r in m.groupBy("shard").agg(F.sum("bytes").alias("load")).collect()}
    assert len(shards(now)) == 512 and max(loads(now).values()) - min(loads(now).values()) <= 120
    more = sharding.cut(sharding.grown(now, 10))
    assert all(s == shards(now)[k] or s in (8, 9) for k, s in shards(more).items()) and more.first().version == 3
    assert min(loads(more)[8], loads(more)[9]) > 0.8 * sum(loads(now).values()) / 10
    fewer = sharding.cut(sharding.rebalanced(more, 6))
    assert set(loads(fewer)) == set(range(6)) and max(loads(fewer).values()) - min(loads(fewer).values()) <= 120
    with pytest.raises(ValueError):
        sharding.grown(now, 8)


def test_shards_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}", k * 0.5) for k in range(300)] + [(None, None, None)], "doc_id long, text string, extra double")
    sharding.assigned(docs, 5, folder=str(tmp_path / "map"))
    current = sharding.load_map(spark, str(tmp_path / "map"))
    sharding.write_shards(docs, current, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.drop("shard").collect())) == sorted(map(str, docs.collect()))
    expected = {r.doc_id: r.shard for r in sharding.assigned(docs, 5).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == expected and len(set(expected.values())) == 5


def test_no_rows_are_sharded(spark):
    assert sharding.assigned(spark.createDataFrame([], "doc_id long, text string"), 40).count() == 0


def test_slots_are_native(spark, sf_dir):
    plan = sharding.slotted(sharding.records(spark.read.parquet(f"{sf_dir}/documents.parquet")))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "ExistingRDD"))


# --- 2: a hot id --------------------------------------------------------------------------------------------------------


def test_a_repeated_label_brings_one_text_to_the_driver(spark, monkeypatch):
    from gneiss.llm import toxicity

    rows = [(1, f"copy {k} of a text", "en") for k in range(3000)] + [(k, "clean words here", "en") for k in range(2, 40)] + [(50, None, None), (None, "x", "en")]
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, langs: seen.append((len(texts), sorted(toxic))))
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(k, int(k == 1)) for k in [*range(1, 40), 1, 50]] + [(None, 1)], "doc_id long, toxic int"))
    assert seen == [(40, [0] * 39 + [1])]
