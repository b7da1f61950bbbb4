"""Operator 3: language-model scoring with a log-bilinear neural model.

Counting: words of all training texts are counted (per task, then by Spark). Classes: the most frequent words (OWN_CLASS
at most) are a class each; every other word belongs to a class by the hash of its last bytes, so endings, which tell
languages and kinds of text apart, are seen by the model; the end of a text is a class too. Every text becomes a line of
classes once; training and scoring read the lines.

Model: the representation of the next class is the sum of two vectors, one for each of the two classes before; its
score is the inner product with the class's own vector plus a bias. It is trained by noise-contrastive estimation in
numpy, over all training tokens, from the unigram model on. The lines are dealt by row to slices of about SLICE_TOKENS
tokens, whatever the table's partitions, so a slice's model has seen enough, and the slices to ROUNDS rounds (fewer where
there are fewer slices). Every slice of a round is trained from the last round's mean; then the weights are averaged row
by row, each weighted by how often the slice saw the row, the squares of gradients that set each row's step included
(iterative parameter mixing). So every token is learned from once, and the model goes through ROUNDS slices in sequence.

Scoring: since exp(a + b) = exp(a) exp(b), the normalisers of all contexts are one matrix product, made by blocks; token
log-probabilities are inner products less normalisers, so they are normalised over all classes. Within a class of several
words a word has (c + 1) / (sum over the class's training words of (c + 1), plus 1 for all unknown ones), so the
probabilities over known words and one unknown word per class add up to 1.

Frequent words' counts (DICTIONARY words at most, none longer than WORD_BYTES) are broadcast; the other words of every
text go through a join with the counts, so no table that grows with the corpus is held in one place.

Defined results: a null text is an empty text, whose only token is the end; a null id counts as the empty text when the
training rows are chosen; rows that repeat are scored, and learned from, each; words that tie in count are taken into
the dictionary by hash, which changes no score but by rounding; a text of any length is one line (two bytes a token);
without training rows all counts are 0 and base scores 0; an empty table gives an empty result. Other columns, of any
name, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Shipped, bound_batches, by_value, read, spool

by_value(__name__)

FOLDS, HELD_OUT_FOLD = 7, 2
#: At most so many words' counts are broadcast, of words up to so many bytes.
DICTIONARY, WORD_BYTES = 150_000, 64
OWN_CLASS, ENDINGS, ENDING_BYTES = 4096, 512, 3
DIMS, NOISE, BATCH, RATE = 32, 96, 512, 0.1
SLICE_TOKENS, ROUNDS = 2_000_000, 4
#: Steps whose noise is drawn at once.
STEPS = 1024
NAMES = ("one", "two", "out", "bias")
END = b""  # no word is empty


def fold(ident: Column) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % FOLDS


def word_counts(train: DataFrame) -> DataFrame:
    """word (binary), n, over all texts; the end counts once a text."""

    def run(batches):
        def out(counter):
            return pa.RecordBatch.from_arrays([pa.array(list(counter.keys()), pa.binary()), pa.array(list(counter.values()), pa.int64())], names=["word", "n"])

        counter: Counter = Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                long = 0
                for t in batch.slice(start, 256).column("text").cast(pa.binary()).to_pylist():
                    words = (t or b"").lower().split()
                    counter.update(words)
                    counter[END] += 1
                    long += sum(map(len, words)) > 1 << 20
                if len(counter) > 400_000 or long:  # long texts may hold long words
                    yield out(counter)
                    counter = Counter()
        if counter:
            yield out(counter)

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ending(word: bytes) -> int:
    return zlib.crc32(word[-ENDING_BYTES:]) % ENDINGS


class Vocabulary:
    """Dictionary words (those with the largest counts, then by word), the classes and the totals."""

    def __init__(self, words: list[bytes], counts: np.ndarray, ending_counts: np.ndarray, ending_mass: np.ndarray, end: int, tokens: int, kinds: int):
        own = min(OWN_CLASS, len(words))
        self.words, self.end, self.tokens, self.kinds, self.own = words, end, tokens, kinds, own
        self.classes = own + ENDINGS + 1
        self.log = np.log10(counts + 1.0)
        self.cls = np.array([i if i < own else own + ending(w) for i, w in enumerate(words)], np.int64)
        for w, c in zip(words[:own], counts[:own].tolist()):  # these have classes of their own
            ending_counts[ending(w)] -= c
            ending_mass[ending(w)] -= c + 1
        self.mass = np.log10(np.maximum(ending_mass, 0) + 1.0)  # with 1 for unknown words
        q = np.concatenate([counts[:own], np.maximum(ending_counts, 0), [end]]) + 0.5
        self.q = q / q.sum()
        self.index: dict[bytes, int] = {}

    def classed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Dictionary places (-1 outside) and classes of a text's words."""
        if len(self.index) < len(self.words):
            self.index = {w: i for i, w in enumerate(self.words)}
        at = np.fromiter(map(self.index.get, words, [-1] * len(words)), np.int64, len(words))
        cls = self.cls[at] if len(self.cls) else np.empty(len(words), np.int64)
        for i in np.flatnonzero(at < 0).tolist():
            cls[i] = self.own + ending(words[i])
        return at, cls


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and the words outside its dictionary with their counts. The dictionary takes words by levels of
    their counts, and of the level that doesn't fit whole a part by hash."""
    words = counts.where(F.col("word") != F.lit(END))
    words = words.withColumn("level", F.floor(F.log2("n") * 16).cast("int")).withColumn("part", F.pmod(F.xxhash64("word"), F.lit(1024)).cast("int"))
    short = F.octet_length("word") <= WORD_BYTES
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0))).first()
    levels = sorted(((r["level"], r["many"]) for r in words.where(short).groupBy("level").agg(F.count("*").alias("many")).collect()), reverse=True)  # a thousand rows at most
    least, room, until = 1 << 20, DICTIONARY, 0
    for at, many in levels:
        if many > room:
            parts = {r["part"]: r["many"] for r in words.where(short & (F.col("level") == at)).groupBy("part").agg(F.count("*").alias("many")).collect()}  # 1024 rows
            while until < 1024 and parts.get(until, 0) <= room:
                room -= parts.get(until, 0)
                until += 1
            break
        least, room = at, room - many
    inside = short & ((F.col("level") >= least) | ((F.col("level") == (at if levels else 0)) & (F.col("part") < until)))
    top = words.where(inside).select("word", "n").toArrow()  # DICTIONARY rows at most
    n, w = top["n"].to_numpy(), top["word"].to_pylist()
    order = sorted(range(len(w)), key=lambda i: (-n[i], w[i]))
    by_ending = words.groupBy((F.crc32(F.substring("word", -ENDING_BYTES, ENDING_BYTES)) % ENDINGS).alias("e")).agg(F.sum("n").alias("n"), F.sum(F.col("n") + 1).alias("m")).collect()
    c, m = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in by_ending:
        c[r["e"]], m[r["e"]] = r["n"], r["m"]
    return Vocabulary([w[i] for i in order], n[order].astype(np.float64), c, m, totals[2], totals[0], totals[1]), words.where(~inside).select("word", "n")


def start_weights(v: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    k = v.classes
    w = {"one": rng.normal(0, 0.3, (k + 1, DIMS)), "two": rng.normal(0, 0.3, (k + 1, DIMS)), "out": rng.normal(0, 0.1, (k, DIMS)), "bias": np.log(v.q)[:, None]}
    w |= {f"{n}_sum": np.full(x.shape, 1e-2) for n, x in w.items()}  # squares of gradients so far
    return {n: x.astype(np.float32) for n, x in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; exp of 80 is no overflow yet."""
    np.negative(x, out=x)
    np.minimum(x, np.float32(80), out=x)
    np.exp(x, out=x)
    x += np.float32(1)
    np.reciprocal(x, out=x)
    return x


class Trainer:
    """Noise-contrastive estimation with Adagrad over one slice's tokens. Only the rows that a batch touches move."""

    def __init__(self, weights: dict, q: np.ndarray, seed):
        self.w = {k: weights[k].copy() for k in NAMES}
        self.sum = {k: weights[f"{k}_sum"].copy() for k in NAMES}
        for part in (self.w, self.sum):  # a class's vector and bias move together: one array, of which both are views
            part["both"] = np.concatenate([part["out"], part["bias"]], axis=1)
            part["out"], part["bias"] = part["both"][:, :DIMS], part["both"][:, DIMS:]
        self.seen = {k: np.zeros(len(weights[k])) for k in NAMES}
        self.bound = np.uint16 if len(weights["one"]) < 1 << 16 else np.int64  # short keys are sorted by radix
        self.edges, self.logq = np.cumsum(q), (np.log(q) + np.log(NOISE)).astype(np.float32)
        self.rng = np.random.default_rng(seed)

    def run(self, rows: np.ndarray) -> None:
        for name, at in zip(NAMES, (1, 0, 2, 2)):
            self.seen[name] += np.bincount(rows[:, at], minlength=len(self.seen[name]))
        rows = np.ascontiguousarray(rows.take(self.rng.permutation(len(rows)), axis=0).T)
        for block in range(0, rows.shape[1], BATCH * STEPS):
            part = rows[:, block : block + BATCH * STEPS]
            starts = range(0, part.shape[1], BATCH)
            noise = np.searchsorted(self.edges, self.rng.random((len(starts), NOISE)) * self.edges[-1])
            for start, own in zip(starts, noise):
                self.step(*part[:, start : start + BATCH], own)

    def _move(self, name: str, at: np.ndarray, gradient: np.ndarray, size: float) -> None:
        order = at.astype(self.bound).argsort(kind="stable")
        sorted_ = at[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        rows = sorted_[starts]
        g = np.add.reduceat(gradient.take(order, axis=0), starts, axis=0)
        g *= np.float32(1 / size)
        past = g * g
        past += self.sum[name].take(rows, axis=0)
        self.sum[name][rows] = past
        g *= np.float32(RATE)
        g /= np.sqrt(past, out=past)
        self.w[name][rows] = np.subtract(self.w[name].take(rows, axis=0), g, out=g)

    def step(self, two: np.ndarray, one: np.ndarray, target: np.ndarray, noise: np.ndarray) -> None:
        w, n = self.w, len(target)
        hidden = np.ones((n, DIMS + 1), np.float32)  # the last is multiplied by the bias
        hidden[:, :DIMS] = w["one"].take(one, axis=0)
        hidden[:, :DIMS] += w["two"].take(two, axis=0)
        at = np.concatenate([target, noise])
        both = w["both"].take(at, axis=0)
        own, others = both[:n], both[n:]
        true = _sigmoid(np.einsum("ij,ij->i", hidden, own) - self.logq[target]) - 1
        false = hidden @ others.T
        false -= self.logq[noise]
        _sigmoid(false)
        to_hidden = false @ others[:, :DIMS]
        to_hidden += true[:, None] * own[:, :DIMS]
        np.multiply(hidden, true[:, None], out=own)
        np.matmul(false.T, hidden, out=others)
        size = n / 32
        self._move("one", one, to_hidden, size)
        self._move("two", two, to_hidden, size)
        self._move("both", at, both, size)


def triples(classes: list[np.ndarray], k: int) -> np.ndarray:
    """(class two before, class before, class) of every token, ends included; before a text stands the start. k: the
    number of classes, of which the end is the last."""
    out = []
    for c in classes:
        line = np.concatenate([[k, k], c, [k - 1]])
        out.append(np.stack([line[:-2], line[1:-1], line[2:]], 1))
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def lines(docs: DataFrame, shipped: Shipped) -> DataFrame:
    """Per text a row (row, id, n, known, base, within, classes) from the dictionary, and a row (row, n, word) for each of
    its words outside the dictionary. docs: id, text."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        v = shipped.value
        first, made = TaskContext.get().partitionId() << 40, 0
        names = ["row", "id", "n", "known", "base", "within", "classes", "word"]
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                facts, rare = [], []
                for t in part.column("text").cast(pa.binary()).to_pylist():
                    words = (t or b"").lower().split()
                    at, cls = v.classed(words)
                    known = at >= 0
                    logs = float(v.log[at[known]].sum()) + float(np.log10(v.end + 1.0))
                    classed = cls >= v.own
                    within = float(v.log[at[known & classed]].sum()) - float(v.mass[cls[classed] - v.own].sum())
                    facts.append((first + made, len(words) + 1, int(known.sum()) + int(v.end > 0), logs, within, cls.astype("<u2").tobytes()))
                    rare += [(first + made, w, n) for w, n in Counter([words[i] for i in np.flatnonzero(~known).tolist()]).items()]
                    made += 1
                r, n, k, base, within, cls = zip(*facts)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), part.column("id"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(base, pa.float64()), pa.array(within, pa.float64()), pa.array(cls, pa.binary()), pa.nulls(len(r), pa.binary())], names=names)
                if rare:
                    r, w, n = zip(*rare)
                    none = pa.nulls(len(r), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.nulls(len(r), part.schema.field("id").type), pa.array(n, pa.int64()), pa.nulls(len(r), pa.int64()), none, none, pa.nulls(len(r), pa.binary()), pa.array(w, pa.binary())], names=names)

    return docs.mapInArrow(run, f"row long, id {kind}, n long, known long, base double, within double, classes binary, word binary")


def train(learn: DataFrame, slices: int, q: np.ndarray, weights: dict, round_: int, rounds: int) -> dict:
    """One round of parameter mixing, over its part of the slices. learn: row, classes, of all training texts."""
    spark = learn.sparkSession
    shared, k = Shipped(spark, (weights, q)), len(q)
    columns = [f"v{i}" for i in range(2 * DIMS)]
    dealt = learn.select(F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"), "row", "classes").where(F.col("slice") % rounds == round_)

    def run(own: pa.Table) -> pa.Table:
        weights, q = shared.value
        own = own.sort_by("row")
        trainer = Trainer(weights, q, [own["slice"][0].as_py(), round_])
        trainer.run(triples([np.frombuffer(c, "<u2").astype(np.int32) for c in own["classes"].to_pylist()], k))
        parts = []
        for i, name in enumerate(NAMES):
            at = np.flatnonzero(trainer.seen[name])
            if len(at):
                seen = trainer.seen[name][at]
                x = np.zeros((len(at), 2 * DIMS))
                width = trainer.w[name].shape[1]
                x[:, :width], x[:, DIMS : DIMS + width] = trainer.w[name][at], trainer.sum[name][at]
                x *= seen[:, None]
                parts.append(pa.table([pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(seen), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=["part", "row", "seen", *columns]))
        return pa.concat_tables(parts)

    rows = dealt.groupBy("slice").applyInArrow(run, "part int, row long, seen double, " + ", ".join(f"{c} double" for c in columns))
    mixed = rows.groupBy("part", "row").agg(F.sum("seen").alias("seen"), *(F.sum(c).alias(c) for c in columns)).toPandas()  # a row for each of the model's rows
    out = {n: x.copy() for n, x in weights.items()}
    for i, name in enumerate(NAMES):
        own = mixed[mixed["part"] == i]
        x = own[columns].to_numpy() / own[["seen"]].to_numpy()
        at, width = own["row"].to_numpy(), out[name].shape[1]
        out[name][at], out[f"{name}_sum"][at] = x[:, :width], x[:, DIMS : DIMS + width]
    return out


def normalisers(weights: dict, block: int = 512) -> np.ndarray:
    """The log normaliser of every context (class two before, class before): one matrix product, by blocks of rows."""
    one = weights["one"] @ weights["out"].T
    top1 = one.max(1, keepdims=True)
    one -= top1
    np.exp(one, out=one)
    one *= np.exp(weights["bias"][:, 0])
    out = np.empty((len(weights["two"]), len(one)), np.float32)
    for start in range(0, len(out), block):
        two = weights["two"][start : start + block] @ weights["out"].T
        top2 = two.max(1, keepdims=True)
        out[start : start + block] = np.log(np.exp(two - top2) @ one.T) + top2 + top1.T
    return out


def log_probabilities(weights: dict, norm: np.ndarray, rows: np.ndarray, step: int = 8192) -> float:
    """The sum of the natural logarithms of the class probabilities of (class two before, class before, class)."""
    total = 0.0
    for start in range(0, len(rows), step):
        a, b, c = rows[start : start + step].T
        own = np.einsum("ij,ij->i", weights["one"][b] + weights["two"][a], weights["out"][c]) + weights["bias"][c, 0] - norm[a, b]
        total += float(own.sum(dtype=np.float64))
    return total


class Scorer:
    """The model with its normalisers, which a worker makes once."""

    def __init__(self, weights: dict):
        self.weights, self.norm = {k: weights[k] for k in NAMES}, None

    def score(self, classes: np.ndarray) -> float:
        if self.norm is None:
            self.norm = normalisers(self.weights)
        k = len(self.weights["out"])
        return log_probabilities(self.weights, self.norm, triples([classes], k)) / np.log(10)


def scored(texts: DataFrame, weights: dict) -> DataFrame:
    """texts: row, id, n, known, base, within, classes. Instead of classes: model, the log10 probability of the line."""
    shipped = Shipped(texts.sparkSession, Scorer(weights))
    kept = ["row", "id", "n", "known", "base", "within"]
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        own = shipped.value
        for batch in batches:
            got = [own.score(np.frombuffer(c, "<u2").astype(np.int64)) for c in batch.column("classes").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(got, pa.float64())], names=[*kept, "model"])

    return texts.select(*kept, "classes").mapInArrow(run, f"row long, id {kind}, n long, known long, base double, within double, model double")


def fitted(facts: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> dict:
    """The trained weights. facts: lines of all texts, spooled."""
    learn = facts.where(F.col("word").isNull() & (fold(F.col("id")) != HELD_OUT_FOLD)).select("row", "classes")
    weights = start_weights(v)
    slices = max(1, round(v.tokens / SLICE_TOKENS))
    rounds = min(rounds, slices)
    for k in range(rounds):
        weights = train(learn, slices, v.q, weights, k, rounds)
    return weights


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row of docs: its id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    bound_batches(spark)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    learn = narrow.where(fold(F.col("id")) != HELD_OUT_FOLD).select("text")
    v, others = vocabulary(spool(word_counts(learn), "counts"))
    facts = spool(lines(narrow, Shipped(spark, v)), "facts")
    texts = spool(scored(facts.where(F.col("word").isNull()), fitted(facts, v, rounds)), "scores")
    rare = facts.where(F.col("word").isNotNull()).select("row", "word", F.col("n").alias("tf")).join(others.select("word", F.col("n").alias("c")), "word")
    rare = rare.groupBy("row").agg(F.sum("tf").alias("_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("_logs"))
    out = texts.join(rare, "row", "left")
    logs = F.coalesce("_logs", F.lit(0.0))
    whole = float(np.log10(v.tokens + v.kinds + 1))
    return out.select(
        F.col("id").alias(id_col), (fold(F.col("id")) == HELD_OUT_FOLD).alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base") + logs - F.col("n") * whole).alias("base_score"), (F.col("model") + F.col("within") + logs).alias("score"),
    )


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))
