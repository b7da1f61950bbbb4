"""Operator 8: quality classifier by nearest-neighbour voting in a latent-semantic space.

A text's features are the counts of its byte pairs, hashed and damped by the logarithm, and the ranges that its shares
of repeated words and lines, capitals and marks fall into, weighted by inverse document frequency. A truncated singular value decomposition of a bounded sample of labelled rows gives the
latent space (numpy, on the driver). The sample's latent vectors, labels and the projection are broadcast; their size
depends on the parameters alone. Every document is projected, its cosines with all labelled vectors come from one
matrix product a block, and its nearest neighbours vote, weighted by similarity and by how many labelled rows each
sampled row stands for.

Defined results: a text without byte pairs (null, empty, one byte) has no neighbours and scores the share of label 1;
without any labelled rows every score is 0.5; rows without a label, or with a null id, are never learned from; an id that
has both labels teaches nothing; of an id's several texts the one of smallest hash (then the smallest) is learned from,
so reruns agree; rows that repeat are scored each; neighbours that tie are interchangeable only if their labels are, so
ties in similarity go by place in the sample, which is in order of ids; a text of any length is counted whole; an empty
table gives an empty result. Other columns, of any name, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Shipped, bound_batches, by_value, read, row_of

by_value(__name__)

WIDTH, LATENT, NEIGHBOURS = 4096, 48, 21
#: The bound on learned rows: so many of each label, those whose ids hash smallest.
SAMPLE_PER_LABEL = 1500
FOLDS, HELD_OUT_FOLD = 5, 0
CUT = 0.3
#: Similarity to this power is a vote's weight.
SHARPNESS = 4


def shares(text: bytes) -> tuple[float, float, float, float]:
    """The shares of words that repeat the word before, of lines that repeat a line, of upper-case letters among ASCII
    letters, and of ASCII marks among all bytes."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words) - 1)
    lined = 1 - len(set(lines)) / max(1, len(lines))
    kinds = _KIND[np.frombuffer(text, np.uint8)]
    n = np.bincount(kinds, minlength=4)
    return again, lined, n[1] / max(1, n[1] + n[2]), n[3] / max(1, len(text))


#: Kinds of bytes: 1 upper case, 2 lower case, 3 other printable ASCII but digits and blank, 0 the rest.
_KIND = np.array([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 32 < b < 127 and not 48 <= b <= 57 else 0 for b in range(256)])
#: Shares are told apart by these limits; a text's place among them is a feature like a byte pair.
LIMITS = np.array([0.0, 0.1, 0.3, 0.6])
STYLE_WEIGHT = 0.5


def counts(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Damped counts of byte pairs, dealt to the first places by a multiplicative hash; the last places are the ranges
    that the text's shares fall into, weighted against the length of the former."""
    b = np.frombuffer(text, np.uint8)
    out = np.zeros(width, np.float32)
    if len(b) < 2:
        return out
    style = 4 * (len(LIMITS) + 1)
    pair = (b[:-1].astype(np.uint32) << np.uint32(8)) | b[1:]
    place = ((pair * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(width - style)
    out[: width - style] = np.log1p(np.bincount(place, minlength=width - style))
    for i, share in enumerate(shares(text)):
        out[width - style + i * (len(LIMITS) + 1) + int(np.searchsorted(LIMITS, share))] = STYLE_WEIGHT * np.linalg.norm(out[: width - style])
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def latent_space(x: np.ndarray, dims: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequencies and the projection (width x dims): randomised truncated SVD with power steps."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x = _unit(x * idf)
    rng = np.random.default_rng(seed)
    dims = min(dims, *x.shape)
    y = x @ rng.standard_normal((x.shape[1], min(dims + 12, *x.shape))).astype(np.float32)
    for _ in range(4):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    return idf, np.ascontiguousarray(vt[:dims].T, np.float32)


def sampled_labels(labels: DataFrame, per_label: int, folds: int, held: int) -> tuple[list[tuple], dict[int, int]]:
    """The sampled (doc_id, label) and the number of learnable rows of each label."""
    own = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    own = own.where(F.crc32(F.col("doc_id").cast("string")) % folds != held)
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_other")).where("quality = _other").select("doc_id", "quality")
    sizes = {r["quality"]: r["n"] for r in own.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    rows = []
    for label in sorted(sizes):
        rows += [tuple(r) for r in own.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).collect()]
    return rows, sizes


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_label: int = SAMPLE_PER_LABEL) -> dict | None:
    spark = docs.sparkSession
    rows, sizes = sampled_labels(labels, per_label, FOLDS, HELD_OUT_FOLD)
    if not rows:
        return None
    wanted = spark.createDataFrame(rows, f"id {labels.schema['doc_id'].dataType.simpleString()}, label int")
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "id")
    narrow = narrow.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_t")).select("id", "label", "_t.text")

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [counts(t or b"") for t in texts]
            places = [np.flatnonzero(f) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(places, pa.list_(pa.int32())), pa.array([f[p] for f, p in zip(found, places)], pa.list_(pa.float32()))], names=["id", "label", "places", "values"])

    got = narrow.mapInArrow(run, f"id {wanted.schema['id'].dataType.simpleString()}, label int, places array<int>, values array<float>")
    got = got.where(F.size("places") > 0).orderBy("id").toArrow()  # bounded by the sample
    if not got.num_rows:
        return None
    x = np.zeros((got.num_rows, WIDTH), np.float32)
    places, values = got["places"].combine_chunks(), got["values"].combine_chunks()
    x[np.repeat(np.arange(len(x)), np.diff(places.offsets.to_numpy())), places.flatten().to_numpy()] = values.flatten().to_numpy()
    y = got["label"].to_numpy()
    idf, projection = latent_space(x, LATENT)
    stands_for = np.array([sizes.get(c, 0) / max(1, (y == c).sum()) for c in (0, 1)], np.float32)[y]
    return {"idf": idf, "projection": projection, "vectors": _unit(_unit(x * idf) @ projection), "labels": y.astype(np.float32), "weights": stands_for, "prior": sizes.get(1, 0) / sum(sizes.values())}


def vote(x: np.ndarray, model: dict, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of the count vectors x (block x width)."""
    z = _unit(_unit(x * model["idf"]) @ model["projection"])
    close = z @ model["vectors"].T
    k = min(neighbours, close.shape[1])
    least = np.partition(close, close.shape[1] - k, axis=1)[:, close.shape[1] - k, None]
    at = np.argsort(np.where(close > least, 0, np.where(close == least, 1, 2)), axis=1, kind="stable")[:, :k]  # ties by place
    weight = np.maximum(np.take_along_axis(close, at, 1), 0).astype(np.float64) ** SHARPNESS * model["weights"][at]
    total = weight.sum(1)
    score = np.divide((weight * model["labels"][at]).sum(1), total, out=np.full(len(x), model["prior"], np.float64), where=total > 0)
    return np.where(z.any(1), np.clip(score, 0, 1), model["prior"])


def _scored(docs: DataFrame, model: dict | None, text_col: str) -> DataFrame:
    """docs' columns with _score after them."""
    spark = docs.sparkSession
    shared = Shipped(spark, model)

    def run(batches):
        own = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                texts = part.column(text_col).cast(pa.binary()).to_pylist()
                score = vote(np.stack([counts(t or b"") for t in texts]), own) if own else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, "_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """Per row of docs: its id, held_out, score, predicted."""
    bound_batches(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, per_label)
    out = _scored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model, "text")
    held = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT_FOLD
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= cut).cast("int").alias("predicted"))


def accepted_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """docs' rows predicted good, with docs' columns."""
    bound_batches(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col)
    # extra columns may repeat names: they travel as one struct
    packed = docs.select(F.col(text_col).alias("text"), row_of(docs).alias("_row"))
    return _scored(packed, model, "text").where(F.col("_score") >= cut).select("_row.*")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
