"""The registered queries and the pipeline, held against slow versions of their own stages."""

import zlib

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from gneiss.llm import quality, queries, simhash, toxicity
from test_llm_operators import groups, slow_fingerprint, slow_ids, slow_measures


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(name, spark, sf_dir, rows_of, duck_rows):
    df = queries.queries()[name](spark, sf_dir)
    names, expected = duck_rows(queries.oracle_sql()[name])
    assert sorted(df.columns) == names and rows_of(df) == expected


# op11 has a row for each negative that it finds, not for each vector: its SQL, above, says how many.
@pytest.mark.parametrize("name", sorted(n for n in queries.queries() if n.startswith("op") and not n.startswith("op11")))
def test_whole_table(name, spark, sf_dir):
    df = queries.queries()[name](spark, sf_dir)
    table = {"op8": "pages", "op10": "embeddings"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert df.count() >= n if name.startswith(("op7", "op9")) else df.count() == n


def test_registered():
    assert {"pipeline", *queries.queries()} <= set(contract.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "simhash_near_dedup", "packing"]


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for r in docs.collect():
        m = dict(zip(quality.MEASURES, slow_measures(r.text)))
        n = m["n_words"]
        bad = n < 10 or 100 * m["n_repeat_words"] > 20 * n or 10 * m["n_symbols"] > n or 10 * m["n_dup_lines"] > 3 * m["n_lines"] or m["word_chars"] < 3 * n or m["word_chars"] > 12 * n
        if not bad:
            kept[r.doc_id] = r.text
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == set(kept)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    model = toxicity.fit(first, labels)
    kept = {k: t for k, t in kept.items() if model.score(t) < toxicity.CUT}
    second = corpus_pipeline.STAGES[1][1](spark, first, sf_dir)
    assert {r.doc_id for r in second.collect()} == set(kept)
    ids = sorted(kept)
    root = groups([slow_fingerprint(kept[k]) for k in ids])
    low = {}
    for k, r in zip(ids, root):
        low.setdefault(r, k)
    third = corpus_pipeline.STAGES[2][1](spark, second, sf_dir)
    assert third.columns == docs.columns and sorted(r.doc_id for r in third.collect()) == sorted(low.values())
    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert set(got) == set(low.values())
    for k, pieces in got.items():
        t = slow_ids(kept[k])
        assert sum(n for _, n, _ in pieces) == len(t) and all(zlib.crc32(t[s : s + n].tobytes()) == c for s, n, c in pieces)


def test_simhash_component_is_smallest_reachable(spark, sf_dir):
    got = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    root = groups([r.fp & (2**64 - 1) for r in got])
    low = {}
    for r, g in zip(got, root):
        low[g] = min(low.get(g, r.doc_id), r.doc_id)
    assert all(r.component_id == low[g] for r, g in zip(got, root))


def test_pipeline_edges(spark, tmp_path):
    """Null and empty texts go, repeated rows count once, extra columns with clashing names do no harm, empty tables give no rows."""
    text = "The quick brown fox jumps over the lazy dog near the river bank today again"
    rows = [(1, text, "en", "s", 3, 1), (1, text, "en", "s", 3, 1), (2, text + " now", None, "s", 3, 2), (3, None, "en", None, None, 3), (4, "", "en", "s", 0, 4), (None, text.replace("fox", "cat and the hen"), "de", "s", 1, 5)]
    for name, some in (("full", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long, kept int").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 0, 0), (1, 0, 0), (None, 1, 1), (9, 1, None)][: 9 * len(some)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert sorted({(r.doc_id, r.doc_tokens) for r in got}, key=str) == (sorted({(k, len(slow_ids(t))) for k, t in ((1, text), (2, text + " now"), (None, rows[-1][1]))}, key=str) if some else [])
        assert len(got) == len({(r.doc_id, r.start) for r in got})
