"""Operator 9: license scan by diagonal voting.

Every rolling word k-gram of a document is hashed and joined to the positions of the k-grams of known license wordings
(some hundred to some thousand rows, bounded by the wordings). A match is a point; points of one wording at one offset
(document position less template position) lie on a diagonal. Votes are counted by diagonal, and neighbouring diagonals
(insertions, deletions) are merged into spans. A span is verified on the words themselves: the least number of inserted,
left out or changed words that turns the wording into a run of the span's words must leave COVERAGE of the wording.

No wording within that many edits is missed: e edits spoil e * k grams at most and shift diagonals by e at most, so k is 3
where at least one gram must be left, else 2, spans need the votes that e edits leave, and diagonals up to e apart are one.

The base labels are phrases whose words stand consecutively.

Defined results: a null text is an empty text, without words, places or labels (labels are empty strings, first_word
and last_word null, score 0); a null id stays null; rows that repeat id and text get the same labels; ties between spans
don't matter, as labels are a set and the score is the best coverage; in a text of any length the spans' words alone are
aligned; an empty table gives an empty result. Other columns, of any name, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Shipped, bound_batches, by_value, read, small_side, spool, text_hash, worker_tables
from .license_texts import TEMPLATES
from .minhash import WordHash, mix64

by_value(__name__)

COVERAGE = 0.7
#: Texts with spans up to this many are broadcast by id against the documents; more are joined by shuffle.
BROADCAST_TEXTS = 1_000_000

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Bytes that are no part of a word become blanks; what is left between blanks are the words.
_BLANK = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z in lower case, then the runs of letters, digits and non-ASCII characters."""
    return (text or b"").lower().translate(_BLANK).split()


def grams(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of the rolling runs of k words."""
    if len(words) < k:
        return np.empty(0, np.int64)
    cache = worker_tables("words").setdefault("words", WordHash())
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(words) - k + 1 + i])
    return out.view(np.int64)


def edits(words: int, coverage: float) -> int:
    """How many edits of a wording of so many words are allowed."""
    return max(0, int(np.floor(words * (1 - coverage) + 1e-9)))


def gram_size(words: int, coverage: float) -> int:
    return 3 if words - 2 - 3 * edits(words, coverage) >= 1 else min(2, words)


def template_grams(spark: SparkSession, templates: dict[str, str], coverage: float) -> DataFrame:
    """A row for each template position: bounded by the wordings, not by the data. _need: the votes of a span; _drift:
    how far its diagonals may lie apart."""
    rows = []
    for label, t in templates.items():
        words = words_of(t.encode())
        k, e = gram_size(len(words), coverage), edits(len(words), coverage)
        own = grams(words, k)
        rows += [(label, i, int(h), max(1, len(own) - e * k), max(1, e), len(words)) for i, h in enumerate(own)]
    return spark.createDataFrame(rows, "_label string, _tpos int, _h long, _need int, _drift int, _words int")


def aligned(wording: list[int], words: list[int]) -> tuple[int, int]:
    """(least edits that turn the wording into a run of the words, the run's end)."""
    t, n = np.array(words, np.int64), len(words)
    row = np.zeros(n + 1, np.int64)  # a run may start anywhere
    places = np.arange(n + 1)
    for i, w in enumerate(wording, 1):
        new = np.empty(n + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (t != w), row[1:] + 1)
        row = np.minimum.accumulate(new - places) + places  # words put in
    end = int(row.argmin())
    return int(row[end]), end


def _places(words: list[bytes], joined: bytes, phrase: bytes) -> list[int]:
    """Where the phrase's words start: found in the joined words, placed by the blanks before."""
    out, at, blanks, counted = [], joined.find(phrase), 0, 0
    while at >= 0:
        blanks += joined.count(b" ", counted, at)
        counted = at
        out.append(blanks)
        at = joined.find(phrase, at + 1)
    return out


def _texts(batch: pa.RecordBatch, step: int = 128):
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        yield part.column("id"), [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def facts(narrow: DataFrame) -> DataFrame:
    """_id, _key, n_words, and the base phrases' places and labels."""

    def run(batches):
        for batch in batches:
            for ids, texts in _texts(batch):
                n, places, labels = [], [], []
                for t in texts:
                    words = words_of(t)
                    joined = b" " + b" ".join(words) + b" "
                    n.append(len(words))
                    found = {v: _places(words, joined, b" " + p.encode() + b" ") for p, v in PHRASES.items()}
                    places.append(sorted(x for own in found.values() for x in own))
                    labels.append(sorted(v for v, own in found.items() if own))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(labels, pa.list_(pa.string()))], names=["_id", "n_words", "_all", "_base"])

    out = narrow.mapInArrow(run, f"_id {narrow.schema['id'].dataType.simpleString()}, n_words long, _all array<long>, _base array<string>")
    return out.select("_id.*", "n_words", "_all", "_base")


def hits(narrow: DataFrame, templates: DataFrame) -> DataFrame:
    """Points: the text's id and key, the label, template position and place of every k-gram that a template has. All
    rolling hashes of all texts go through the join; only the matches are shuffled later."""

    def run(batches):
        for batch in batches:
            for ids, texts in _texts(batch):
                words = [words_of(t) for t in texts]
                rolled = [grams(w, k) for w in words for k in (2, 3)]
                offsets = pa.array(np.cumsum([0, *map(len, rolled)]), pa.int32())
                both = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rolled)))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([ids]).take(pa.array(np.repeat(np.arange(len(texts)), 2))), both], names=["_id", "_rolled"])

    rolled = narrow.mapInArrow(run, f"_id {narrow.schema['id'].dataType.simpleString()}, _rolled array<long>")
    return rolled.select("_id", F.posexplode("_rolled").alias("_pos", "_h")).join(F.broadcast(templates), "_h").select("_id.*", "_label", "_tpos", "_pos", "_need", "_drift", "_words")


def spans(points: DataFrame) -> DataFrame:
    """Votes by diagonal, neighbouring diagonals merged: _id, _key, _label, and the places (_low to _high) between which
    the wording may stand."""
    same = ["_id", "_key", "_label", "_need", "_drift", "_words"]
    diagonals = points.withColumn("_diag", F.col("_pos") - F.col("_tpos")).groupBy(*same, "_diag").agg(F.countDistinct("_tpos").alias("_votes"))
    by = Window.partitionBy("_id", "_key", "_label").orderBy("_diag")
    new = F.coalesce((F.col("_diag") - F.lag("_diag").over(by) > F.col("_drift")).cast("int"), F.lit(1))
    merged = diagonals.withColumn("_new", new).withColumn("_band", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy(*same, "_band").agg(F.sum("_votes").alias("_n"), F.min("_diag").alias("_low"), F.max("_diag").alias("_high")).where("_n >= _need")
    return merged.select("_id", "_key", "_label", (F.col("_low") - F.col("_drift")).alias("_low"), (F.col("_high") + F.col("_words") + F.col("_drift")).alias("_high"))


def verified(narrow: DataFrame, found: DataFrame, templates: dict[str, str], coverage: float) -> DataFrame:
    """_id, _key, _label, coverage, first, last (word places) of the spans whose words bear them out."""
    each = found.groupBy("_id", "_key").agg(F.collect_set(F.struct("_label", "_low", "_high")).alias("_spans"))  # by one text's length
    each = spool(each.select(F.struct(F.col("_id").isNull().alias("nul"), F.coalesce("_id", F.lit(0).cast(found.schema["_id"].dataType)).alias("id"), F.col("_key").alias("key")).alias("_pick"), "_spans"), "spans")
    own = narrow.select("text", F.struct(F.col("id._id").isNull().alias("nul"), F.coalesce("id._id", F.lit(0).cast(found.schema["_id"].dataType)).alias("id"), F.col("id._key").alias("key")).alias("_pick"), "id").join(small_side(each, BROADCAST_TEXTS), "_pick").select("id", "text", "_spans")
    shared = Shipped(narrow.sparkSession, {label: words_of(t.encode()) for label, t in templates.items()})

    def run(batches):
        wordings = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                words = words_of(part.column("text").cast(pa.binary())[0].as_py())
                rows = []
                for s in part.column("_spans")[0].as_py():
                    low, wording = max(0, s["_low"]), wordings[s["_label"]]
                    numbers: dict[bytes, int] = {}
                    window = [numbers.setdefault(w, len(numbers)) for w in words[low : max(low, s["_high"])]]
                    wanted = [numbers.get(w, -1) for w in wording]
                    miss, end = aligned(wanted, window)
                    share = 1 - miss / len(wording)
                    if miss <= edits(len(wording), coverage):
                        start = end - aligned(wanted[::-1], window[:end][::-1])[1]
                        rows.append((s["_label"], share, low + start, low + end - 1))
                if rows:
                    label, share, first, last = zip(*rows)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array([0] * len(rows))), pa.array(label), pa.array(share), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["_id", "_label", "coverage", "first", "last"])

    out = own.mapInArrow(run, f"_id {own.schema['id'].dataType.simpleString()}, _label string, coverage double, first long, last long")
    return out.select("_id.*", "_label", "coverage", "first", "last").distinct()  # rows equal in id and text


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """The verified spans themselves: _id, _key (the text's hash), _label, coverage, first, last."""
    bound_batches(docs.sparkSession)
    templates = templates or TEMPLATES
    narrow = _narrow(docs, id_col, text_col)
    return verified(narrow, spans(hits(narrow, template_grams(docs.sparkSession, templates, coverage))), templates, coverage)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.struct(F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("_key")).alias("id"), F.col(text_col).alias("text"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Per row of docs: its id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans."""
    found = license_spans(docs, id_col, text_col, templates, coverage).groupBy("_id", "_key").agg(F.collect_set("_label").alias("_found"), F.max("coverage").alias("_cover"), F.count("*").alias("n_spans"))
    found = small_side(spool(found.select(F.col("_id").alias("_id2"), F.col("_key").alias("_key2"), "_found", "_cover", "n_spans"), "found"), BROADCAST_TEXTS)
    based = facts(_narrow(docs, id_col, text_col))
    out = based.join(found, based["_id"].eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2")), "left")
    own = F.coalesce("_found", F.array().cast("array<string>"))
    return out.select(
        F.col("_id").alias(id_col), "n_words", F.size("_all").cast("long").alias("n_base"), F.array_min("_all").cast("long").alias("first_word"), F.array_max("_all").cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort("_base")).alias("base_labels"), F.concat_ws(",", F.array_sort(F.array_union("_base", own))).alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_cover", F.lit(0.0))).alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
