import os

import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows():
    base = " ".join(f"word{i}" for i in range(120))
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " tail", "en", "b", 1), (4, "", "en", "b", 0), (5, None, "en", None, None), (6, LONG, None, "b", 9), (7, "short text", "de", "", 1),
            (8, " \t\n ", "en", "b", 1), (9, base, "en", "a", 1), (9, base, "en", "a", 1), (None, base, "en", "a", 1), (None, None, None, None, None), (10, "one\none\ntwo\none\n\n", "en", "a", 1),
            (11, "Größe ＡＢ İ Σσς <|endoftext|> 'S don't", "en", "a", 1), (12, "gnu General  Public-License, mit license CC BY", "en", "c", 1)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names the operators use."""
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    for name in ("size", "_key", "id", "row", "kept", "shard", "_size", "word", "n", "_row", "score", "label", "_kept", "a.b", "pick", "_pick", "_mid", "file", "_id", "_src"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
