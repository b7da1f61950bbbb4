"""The corpus pipeline: from raw documents to token hashes of a deduplicated, mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder (spark.checkpoint.dir) and rereads it as the next stage's documents. The stages' decisions take effect: a
document rejected by the classifier, by the rules or as a near-duplicate is gone, and the mix repeats documents.

Defined results of every stage: null and empty texts go through as documents without words (the rules reject them);
a null id, source or other column is kept as it is; texts of any length are read whole; rows that repeat are judged each
by classifier and rules, and one of them stays after near-duplicates; ties (of copies, and of keys in the mix) go by id,
then by text hash; an empty table gives an empty result; other columns, of any name, go through all stages but the last,
which returns its operator's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tissuequery.llm import bpe, minhash, mixing, quality_classifier, quality_rules
from tissuequery.llm._common import read, spool, unspool


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted good; a text without byte pairs scores the share of good labels."""
    return quality_classifier.accepted_documents(docs, read(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose source passes; texts without words fail."""
    return quality_rules.kept_documents(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of smallest id (null last), then of smallest text hash."""
    return minhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Hashes of ids and of decoded texts, a row a row."""
    return bpe.encode_documents(docs)


STAGES = [("quality classifier", classify), ("quality rules", rules), ("near-duplicates", deduplicate), ("mixing", mix), ("BPE", encode)]

#: A trained classifier, near-duplicate components and a tokenizer can't be expressed in SQL; tests hold every stage
#: against its operator's brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spool(docs, f"stage{k}")
            unspool(before)
    return docs
