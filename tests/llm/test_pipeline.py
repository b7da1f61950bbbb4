"""The pipeline's stages against their operators, and its run on edge cases."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tissuequery.llm import bpe, minhash, mixing, quality_classifier, quality_rules


def test_stages(spark, sf_dir, documents):
    docs = documents
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "quality rules", "near-duplicates", "mixing", "BPE"]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == documents.columns
            out = out.persist()
        if k == 0:
            assert ids(out) == ids(quality_classifier.classify(docs, labels).where("predicted = 1"))
        elif k == 1:
            assert ids(out) == ids(quality_rules.judge(docs).where("kept").select(F.col("_row").alias("doc_id")))
        elif k == 2:
            assert ids(out) == ids(minhash.near_duplicates(docs).where("kept"))
        elif k == 3:
            assert ids(out) == sorted(r["doc_id"] for r in mixing.mix_sources(docs).collect() for _ in range(r["copies"]))
        else:
            assert out.count() == docs.count() and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
        docs = out


def test_empty_table(spark, sf_dir, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_run_on_edge_cases(spark, sf_dir, edge, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names, through run() itself."""
    edge.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted((str(r["doc_id"]), r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).persist()
        assert docs.columns == edge.columns
    assert got == sorted((str(r["doc_id"]), r["ids_sha256"]) for r in corpus_pipeline.encode(spark, docs, str(tmp_path)).collect())


def test_run_on_an_empty_table(spark, sf_dir, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
