"""Known values and properties."""

import hashlib
import hmac

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import compaction, search, source_code, sqlfacade


@pytest.mark.parametrize(("text", "n"), [("", 0), ("a", 1), ("Hello World " * 100, 300), ("你好世界" * 100, 266), ("Hello 你好 World 世界 " * 50, 308)])
def test_tokens(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(T.estimate_tokens(F.col("t"))).first()[0] == n == compaction.tokens(text)


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60))
def test_tokens_nearly_additive(a, b):
    assert abs(compaction.tokens(a + b) - compaction.tokens(a) - compaction.tokens(b)) <= 1


def test_tokenizer_pairs(spark):
    assert spark.createDataFrame([("测试用例 Ab1",)], "t string").select(T.tokens(F.col("t"))).first()[0] == ["测", "试", "用", "例", "ab1", "测试", "用例"]


def test_hmac_and_split(spark):
    df = spark.createDataFrame([("a 'b c' d",), (None,), ("it's",)], "t string")
    assert [r[0] for r in df.select(source_code.hmac_hex(F.col("t"), "k")).collect()] == [hmac.new(b"k", b"a 'b c' d", hashlib.sha256).hexdigest(), None, hmac.new(b"k", b"it's", hashlib.sha256).hexdigest()]
    assert [r[0] for r in df.select(source_code.command_split(F.col("t"))).collect()] == [["a", "b c", "d"], [], ["it's"]]


def test_fuzzy_block(spark):
    df = spark.createDataFrame([("x\nfoo(1)  \n\tbar\ny",), ("nothing",)], "t string")
    assert [r[0]["line"] for r in df.select(source_code.fuzzy_block(F.col("t"), "foo(1)\n    bar")).collect()] == [1, -1]


def test_sql_guard(spark, sf_dir):
    sqlfacade.register(spark, sf_dir, ("nation",))
    assert sqlfacade.select(spark, "SELECT * FROM nation", 3).count() == 3
    for bad in ("DROP TABLE nation", "WITH x AS (SELECT 1) SELECT * FROM x"):
        with pytest.raises(ValueError):
            sqlfacade.select(spark, bad)


def test_jaccard_brute_force(spark):
    texts = ["a b c d e", "a b c d e f", "a b c d", "x y", "x y", "", "E d C b a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {(r.a, r.b) for r in search.jaccard_pairs(df, "id", F.col("t"), 0.8).collect()}
    sets = {}
    for k, t in enumerate(texts):
        sets.setdefault(frozenset(t.lower().split()), k)
    items = [(k, s) for s, k in sets.items() if s]
    assert got == {(a, b) for a, s in items for b, u in items if a < b and len(s & u) / len(s | u) >= 0.8}


def test_glob():
    import re

    assert re.match(T.glob_regex("*.py"), "a/b.py") and not re.match(T.glob_regex("?.py"), "ab.py")


def test_greedy_merge_equals_the_loop(spark):
    import random

    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)}
    merged, into = set(), {}
    for k in sorted({x for p in pairs for x in p}):
        if k not in merged:
            into[k] = k
            for a, b in sorted(pairs):
                if a == k and b not in merged:
                    merged.add(b)
                    into[b] = k
    df = spark.createDataFrame(sorted(pairs), "a long, b long")
    assert {r.id: r["into"] for r in search.greedy_merge(df).collect()} == into
    assert search.greedy_merge(df.limit(0)).count() == 0


def test_equal_token_sets_are_merged_too(spark):
    texts = ["x y z", "a b c d e", "E d C b a", "a b c d e f", "a b c d", "x y z", "", "q", None, "a b c d e f g", "!?", "a f e d c b"]
    sets = [frozenset((t or "").lower().split()) if t != "!?" else frozenset() for t in texts]
    alike = lambda s, u: s == u or len(s & u) >= 0.8 * len(s | u)
    into = {}
    for k, s in enumerate(sets):
        if k not in into:
            near = [j for j in range(k + 1, len(sets)) if j not in into and alike(s, sets[j])]
            into |= {j: k for j in [k, *near]}
    lone = {k for k, s in enumerate(sets) if not any(alike(s, u) for j, u in enumerate(sets) if j != k)}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    rows = search.duplicate_merge(df, "id", F.col("t")).collect()
    assert {r.id: r["into"] for r in rows} == {k: v for k, v in into.items() if k not in lone} and len(rows) == len(texts) - len(lone)


def test_parts_of_sets_meet_similar_ones_only(spark):
    import random

    import numpy as np

    rng = random.Random(8)
    words = [rng.getrandbits(63) for _ in range(60)]
    for least in (0.8, 0.5, 0.9):
        sets = [set(rng.sample(words, rng.randrange(1, 31))) for _ in range(150)]
        sets += [set(list(s)[rng.randrange(3) :]) | set(rng.sample(words, rng.randrange(3))) for s in sets]
        sets += [set(range(k, k + 6)) for k in range(4)]  # all in one part
        n = np.array([len(s) for s in sets])
        i, scheme, sig, total, most = search.parts(np.arange(len(sets)), n, np.array([x for s in sets for x in s], np.int64), search.size_classes(int(n.max()), least), least)
        df, keys = {}, {}
        for k in zip(scheme.tolist(), sig.tolist()):
            df[k] = df.get(k, 0) + 1
        for a, *k, d in zip(i.tolist(), scheme.tolist(), sig.tolist(), most.tolist()):
            keys.setdefault((a, k[0]), (d, []))[1].append(tuple(k))
        lists = {}
        for (a, _), (d, ks) in keys.items():
            for k in sorted(ks, key=lambda k: (df[k], k[1]))[: d + 1]:
                lists.setdefault(k, set()).add(a)
        met = {(a, b) for x in lists.values() for a in x for b in x if a < b}
        alike = {(a, b) for a, s in enumerate(sets) for b, u in enumerate(sets) if a < b and s != u and len(s & u) >= least * len(s | u)}
        assert alike <= met and len(alike) > 20
    rows = [(k, " ".join(f"w{x}" for x in {j for j in range(12) if j != k % 12} | {1000 + k * 9 + j for j in range(12)} | {99})) for k in range(200)]
    classes = search.token_classes(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"))
    assert search.candidates(classes, 0.8).count() == 0


def test_sets_that_only_share_rare_tokens_are_no_candidates(spark):
    import random

    pick = random.Random(3)
    sets = [{f"common{k}" for k in range(8)} | {f"w{pick.randrange(10000)}" for _ in range(pick.choice((40, 60)))} for _ in range(250)]
    sets += [(sets[k] | {f"new{k}"}) - {f"common{k % 8}"} for k in range(60)] + [{f"x{j}" for j in range(1500)} | {f"y{k}_{j}" for j in range(130 + 90 * (k % 2))} for k in range(8)]
    rows = [(i, " ".join(y.replace("_", "z") for y in sorted(x))) for i, x in enumerate(sets)]
    docs = spark.createDataFrame(rows, "id long, text string")
    tokens = [set(t.split()) for _, t in rows]
    alike = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if len(tokens[a] & tokens[b]) >= 0.8 * len(tokens[a] | tokens[b])}
    assert {(r.a, r.b) for r in search.jaccard_pairs(docs, "id", F.col("text")).collect()} == alike and len(alike) > 60
    met = {(r.a, r.b) for r in search.candidates(search.token_classes(docs, "id", F.col("text")), 0.8).collect()}
    assert alike <= met and len(met) < 2 * len(alike)  # one shared token makes more than 10,000


def test_top_terms_are_counted_within_a_text(spark):
    from collections import Counter

    texts = ["b a b a c d", "", None, "x", "Q q w w e e e r", "a " * 3 + "b " * 3 + "c " * 2 + "d " * 4, "z y x w"]
    rows = [*enumerate(texts), (50, "m m k"), (50, "k k k j"), (None, "s s"), (None, "t s")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {}
    for r in search.top_terms(df, "doc_id", F.col("text"), 3).collect():
        got.setdefault(r.doc_id, []).append((r.term, r.tf))
    for k, t in enumerate(texts):
        words = (t or "").lower().split()
        best = sorted(Counter(words).items(), key=lambda c: (-c[1], words.index(c[0])))[:3]
        assert sorted(got.get(k, [])) == sorted((w, round(n / len(words), 6)) for w, n in best)
    assert {w for w, _ in got[50]} == {"k", "m", "j"} and {w for w, _ in got[None]} == {"s", "t"}
    plan = search.top_terms(df, "doc_id", F.col("text"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan


def test_fuzzy_block_equals_a_plain_loop(spark):
    import difflib
    import random

    rng = random.Random(5)
    for block in ("Licensed, v 2.0.", "ab\n\tcd", ""):
        texts = ["\n".join(rng.choice([block, block[::-1], "Licensed v 2", "ab", "    cd", "\tcd ", "", "zz", "é😀", "2.0 ,v desneciL"]) for _ in range(rng.randrange(1, 9))) for _ in range(60)] + [None, "", "\n"]
        wanted = "\n".join(x.rstrip().replace("\t", "    ") for x in block.split("\n"))
        n, expected = block.count("\n") + 1, []
        for t in texts:
            rows = [x.rstrip().replace("\t", "    ") for x in (t or "").split("\n")]
            ratios = [difflib.SequenceMatcher(None, "\n".join(rows[k : k + n]), wanted, autojunk=False).ratio() for k in range(max(1, len(rows) - n + 1))]
            top = max(ratios)
            expected.append((ratios.index(top) if top >= 0.8 else -1, top))
        df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
        assert [tuple(r[0]) for r in df.select(source_code.fuzzy_block(F.col("t"), block)).collect()] == expected


def test_few_bytes_with_much_work_are_many_tasks(spark, tmp_path):
    from gneiss.plans import base, python_queries, source_queries

    spark.range(3000).selectExpr("id AS c_custkey", "'a' AS c_mktsegment", "'b' AS c_name").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3000).selectExpr("id AS doc_id", "'a' AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for query in (source_queries.profile_roundtrip, python_queries.fuzzy_block_match):
        assert query(spark, str(tmp_path)).rdd.getNumPartitions() == base.TASKS
