"""The corpus pipeline: quality rules, toxicity, SimHash near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm import packing, quality, simhash, toxicity
from gneiss.llm.queries import BYTE_BPE
from gneiss.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the current policy of the rule ledger."""
    return quality.keep(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on labelled ones among them, doesn't predict to be toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    return toxicity.keep(docs, toxicity.fit(docs.where(~toxicity.held_out()), labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, by sequence and offset."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [("quality_rules", quality_rules), ("toxicity", drop_toxic), ("simhash_near_dedup", near_dedup), ("packing", pack)]
#: A trained classifier, connected components and tokenizers aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages, rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            path = shared_folder(spark, f"stage-{n}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
