"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from gneiss.llm import arc, chat, embedding_dedup, hard_negatives, langid, merkle, packing, quality, sharding, simhash, spans, tokenfile, toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document. Null and empty texts have fingerprint zero; a null id is never the smallest unless all of its component are null."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op2_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document. Null and empty texts have the score of no words; a null id is not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.where(~toxicity.held_out()), _table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "threshold", "flagged")


def _span_digest(encoder: spans.SpanEncoder, texts: list[str | None]) -> list[pa.Array]:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = [encoder.encode(t) for t in texts]
    return [
        pa.array([len(e.ids) for e in found], pa.int64()),
        pa.array([sha(",".join(map(str, e.ids.tolist()))) for e in found]),
        pa.array([sha(encoder.decode(e.ids)) for e in found]),
        pa.array([int(np.sum(e.end - e.begin)) for e in found], pa.int64()),
    ]


def op3_sentencepiece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, digests of what the operator returns; covered_bytes sums the spans. Null counts as empty."""
    extra = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()), StructField("covered_bytes", LongType())]
    return spans.encoded_as(_table(spark, sf_dir, "documents"), PIECES, ("doc_id",), extra, _span_digest)


def op4_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document. Null and empty texts have zero words and fail."""
    rows = quality.ledger(_table(spark, sf_dir, "documents"))
    base = quality.passes("base")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), (base & quality.passes()).alias("kept"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, and what it alone rejects, counted by the ledger's bits."""
    return quality.ablations(quality.ledger(_table(spark, sf_dir, "documents")))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, read back from the files. Null counts as empty; null ids come first, equal ids by their text's hash."""
    return tokenfile.write_and_read(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_language_hd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document. Texts that are null or without a letter are und with score 0; a null id is not held out."""
    docs = _table(spark, sf_dir, "documents")
    profiles = langid.fit(docs.where(~langid.held_out()))
    return langid.identified(docs, profiles).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_chat_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a line of each transcript. Null texts are one empty line; lines of null or other roles are parsed, but not learnt from."""
    lines = chat.transcript_lines(_table(spark, sf_dir, "conversations"))
    held_out = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))  # the model learns from the others
    model = chat.fit(lines.where(~held_out))
    return chat.parse(lines, model, ("role",)).withColumn("held_out", held_out)


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a page, read back from the archives. Null html is an empty payload, which is a payload like any other."""
    return arc.write_and_read(_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a piece. Null counts as empty, which is the end id alone."""
    return packing.pack(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a vector. Null, zero and non-finite vectors, and those of a null label, have no links and are kept."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row an anchor, positive and negative. Rows without a label, or with a vector that isn't sound, take no part."""
    return hard_negatives.mine(hard_negatives.prepared(_table(spark, sf_dir, "embeddings")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document. Null fields are hashed as a dash; the group of null languages comes first."""
    return merkle.manifest(_table(spark, sf_dir, "documents"))


#: Shards of the sharding query.
SHARDS = 40


def op13_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document. Null texts have the size of no text; null ids are hashed like any other."""
    return sharding.assigned(_table(spark, sf_dir, "documents"), SHARDS)


ALL = (op1_simhash_near_dedup, op2_toxicity_cnn, op3_sentencepiece_spans, op4_quality_ledger, op5_token_file, op6_language_hd, op7_chat_hmm, op8_arc_to_warc, op9_packing, op10_embedding_near_dedup, op11_hard_negatives, op12_merkle_manifest, op13_virtual_slots, quality_ablations)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_ledger": quality.query_sql(), "quality_ablations": quality.ablation_sql(), "op8_arc_to_warc": arc.QUERY_SQL, "op11_hard_negatives": hard_negatives.QUERY_SQL, "op12_merkle_manifest": merkle.QUERY_SQL}
