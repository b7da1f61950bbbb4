"""The training-data operators against brute force, on the smallest tables and on a table of edge cases."""

import hashlib
import json
import math
import os
import re
import struct
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tissuequery.llm import ann, bpe, language_model, license_scan, minhash, mixing, quality_classifier, quality_rules, registry, sharding, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def collected(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return WORD.findall(text or "")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), c.execute(registry.SQL[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    pd.testing.assert_frame_equal(got[cols].sort_values("doc_id", ignore_index=True), want[cols].sort_values("doc_id", ignore_index=True), check_dtype=False)


# 1


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = float(sum(sizes.values())), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def test_mixing_targets_and_budgets(documents):
    rows = collected(mixing.mix_sources(documents).join(documents.select("doc_id", "source", "text"), "doc_id"))
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in rows:
        assert r["size"] == len(words(r["text"])) and r["taken"] == r["size"] * r["copies"] and r["copies"] <= 3
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    target = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6
        epochs = [r["copies"] for r in rows if r["source"] == s and r["size"]]
        assert max(epochs) - min(epochs) <= 1  # complete epochs first


def test_mixing_edges(spark, edge, empty):
    rows = collected(mixing.mix_sources(edge))
    assert len(rows) == edge.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix_sources(empty).count() == 0
    mixed = mixing.mixed_documents(edge)
    assert mixed.columns == edge.columns and mixed.count() == sum(r["copies"] for r in rows)
    skew = spark.createDataFrame([(i, "a b c", None, "big" if i else "small", 1) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix_sources(skew).groupBy("source_size").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r["t"] - r["target"]) <= 1.5 for r in got)


def test_mixing_of_null_and_repeated_ids(spark):
    """The target is met within half the longest document though a third of a source are equal rows."""
    rows = [(None, "a b c", "s") for _ in range(300)] + [(7, f"u{i} " * (1 + i % 4), "s") for i in range(300)] + [(7, "same", "s")] * 300 + [(i, "x y z w " * (i % 5), "t") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(9)
    for _ in range(2):
        got = mixing.mix_sources(docs).groupBy("target").agg(F.sum("taken").alias("t"), F.max("size").alias("longest"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()
        assert all(abs(r["t"] - r["target"]) <= r["longest"] / 2 + 1e-6 and r["most"] <= 3 for r in got)
    a, b = (sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mixing.mix_sources(docs.repartition(n)).collect()) for n in (2, 5))
    assert a == b


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(8)
    sizes = {f"s{i:05d}": int(x) for i, x in enumerate(rng.pareto(1.0, 3000) * 50)}
    t = spark.createDataFrame([(s, 0, n) for s, n in sizes.items()], "_src string, _nul int, source_size long")
    want = brute_targets(sizes)
    for r in mixing.targets(t).collect():
        assert r["target"] == pytest.approx(want[r["_src"]])


# 2


def brute_rules(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = defaultdict(list)
    for i in range(len(w) - 2):
        grams[tuple(w[i : i + 3])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_rules_edges(spark, edge, empty):
    extra = ["a a a a", "x y z x y z", "a b a b a", "a b", "a a a"]
    more = spark.createDataFrame([(100 + i, t, "en", "a", 1) for i, t in enumerate(extra)], "doc_id long, text string, lang string, source string, n_chars long")
    own = edge.select(*more.columns).union(more)
    got = quality_rules.judge(own, carry=True).select("_row.text", "*").collect()
    assert len(got) == own.count()
    for r in got:
        want = brute_rules(r["text"])
        assert {k: r[k] for k in want} == want
        assert r["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.kept_documents(edge).columns == edge.columns


def test_bad_host_is_rejected(spark):
    good = " ".join(f"plain{i}" for i in range(80))
    bad = " ".join(f"##{i}##" for i in range(80))
    rows = [(h * 1000 + i, bad if h == 0 and i % 20 else good, "en", f"host{h}", 1) for h in range(12) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = quality_rules.judge(docs).groupBy((F.col("_row") < 1000).alias("bad")).agg(F.max(F.col("kept").cast("int")).alias("some"), F.min(F.col("kept").cast("int")).alias("all")).collect()
    assert {r["bad"]: (r["some"], r["all"]) for r in got} == {True: (0, 0), False: (1, 1)}


def test_verdicts_of_many_hosts(documents, monkeypatch):
    whole = sorted(map(tuple, quality_rules.judge(documents).collect()))
    monkeypatch.setattr(quality_rules.with_verdicts, "__defaults__", (2,))
    assert sorted(map(tuple, quality_rules.judge(documents).collect())) == whole


# 3


def test_language_model(documents, texts):
    rows = {r["doc_id"]: r for r in collected(language_model.score_texts(documents))}
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in texts.items()}
    counts = Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    held, base = 0.0, 0.0
    for i, w in tokens.items():
        r = rows[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and r["train_tokens"] == n
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(counts[x] > 0 for x in w)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        if r["held_out"]:
            held, base = held + r["score"], base + r["base_score"]
    assert held > base  # better than the unigram model on texts that it hasn't seen


def test_trained_scores_by_brute_force(documents, texts, monkeypatch):
    """The trained model's scores, token by token: a softmax over all classes, then the word's share of its class. Both add
    up to 1."""
    weights = {}
    fit = language_model.fitted
    monkeypatch.setattr(language_model, "fitted", lambda *a: weights.setdefault("w", fit(*a)))
    narrow = documents.select("doc_id", "text")
    rows = {r["doc_id"]: r["score"] for r in collected(language_model.score_texts(narrow))}
    w = {k: x.astype(float) for k, x in weights["w"].items()}
    learn = narrow.select(F.col("doc_id").alias("id"), "text").where(language_model.fold(F.col("id")) != 2).select("text")
    v, others = language_model.vocabulary(language_model.word_counts(learn))
    assert others.count() == 0
    count = {x: 10**log - 1 for x, log in zip(v.words, v.log)}
    inside = defaultdict(float)
    for x, c in zip(v.words, v.cls.tolist()):
        if c >= v.own:
            inside[c] += count[x] + 1
    for c, total in inside.items():
        assert (total + 1) / 10 ** v.mass[c - v.own] == pytest.approx(1)
    for i in sorted(texts)[:40]:
        line = (texts[i] or "").encode().lower().split()[:4000]
        if len(line) == 4000:
            continue
        a = b = v.classes
        want = 0.0
        for x in [*line, None]:
            z = w["out"] @ (w["one"][b] + w["two"][a]) + w["bias"][:, 0]
            p = np.exp(z - z.max())
            c = v.classes - 1 if x is None else int(v.cls[v.words.index(x)]) if x in count else v.own + language_model.ending(x)
            want += math.log10(p[c] / p.sum())
            if x is not None and c >= v.own:
                want += math.log10((count.get(x, 0) + 1) / (inside[c] + 1))
            a, b = b, c
        assert rows[i] == pytest.approx(want, rel=1e-4, abs=1e-2)


def test_language_model_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    gains = []
    for n in (1, 64):
        r = language_model.score_texts(docs.repartition(n)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
        gains.append(r[0] - r[1])
    assert gains[0] > 0 and gains[1] >= 0.9 * gains[0]


def test_language_model_slices(documents, monkeypatch):
    """Slices meet in the mean: several still beat the base."""
    monkeypatch.setattr(language_model, "SLICE_TOKENS", 10_000)
    r = language_model.score_texts(documents).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_language_model_rare_words_go_through_the_join(documents, monkeypatch):
    whole = {r["doc_id"]: r for r in collected(language_model.score_texts(documents.limit(60)))}
    monkeypatch.setattr(language_model, "DICTIONARY", 40)
    learn = documents.limit(60).select("text")
    v, others = language_model.vocabulary(language_model.word_counts(learn))
    assert 20 <= len(v.words) <= 40 and len(v.words) + others.count() + 1 == v.kinds  # of a level that doesn't fit, a part
    small = {r["doc_id"]: r for r in collected(language_model.score_texts(documents.limit(60)))}
    for i, r in whole.items():
        assert small[i]["base_score"] == pytest.approx(r["base_score"], rel=1e-9) and small[i]["n_known"] == r["n_known"]


def test_language_model_edges(edge, empty):
    rows = collected(language_model.score_texts(edge))
    assert len(rows) == edge.count() and all(math.isfinite(r["score"]) for r in rows)
    assert language_model.score_texts(empty).count() == 0


def test_training_steps_by_hand():
    """A class's vector and bias are one array, moved at once; against plain gradients, one row at a time."""
    m, k = language_model, 40
    rng = np.random.default_rng(1)
    q = rng.uniform(1, 9, k)
    q /= q.sum()
    weights = {"one": rng.normal(0, 0.3, (k + 1, m.DIMS)), "two": rng.normal(0, 0.3, (k + 1, m.DIMS)), "out": rng.normal(0, 0.1, (k, m.DIMS)), "bias": np.log(q)[:, None]}
    weights = {n: x.astype(np.float32) for n, x in (weights | {f"{n}_sum": np.full(x.shape, 1e-2) for n, x in weights.items()}).items()}
    rows = rng.integers(0, k, (1300, 3)).astype(np.int32)
    trainer = m.Trainer(weights, q, [3, 0])
    trainer.run(rows)
    assert np.shares_memory(trainer.w["both"], trainer.w["out"]) and np.shares_memory(trainer.w["both"], trainer.w["bias"])
    w, past = ({n: weights[n + end].astype(float) for n in m.NAMES} for end in ("", "_sum"))
    draw = np.random.default_rng([3, 0])
    order = draw.permutation(len(rows))
    for start in range(0, len(rows), m.BATCH):
        batch = rows[order[start : start + m.BATCH]]
        noise = np.searchsorted(np.cumsum(q), draw.random(m.NOISE) * np.cumsum(q)[-1])
        g = {n: np.zeros(x.shape) for n, x in w.items()}
        for two, one, target in batch:
            h = w["one"][one] + w["two"][two]
            for c, label in [(target, 1.0), *((c, 0.0) for c in noise)]:
                off = 1 / (1 + np.exp(-(h @ w["out"][c] + w["bias"][c, 0] - np.log(q[c]) - np.log(m.NOISE)))) - label
                g["one"][one] += off * w["out"][c]
                g["two"][two] += off * w["out"][c]
                g["out"][c] += off * h
                g["bias"][c, 0] += off
        for n in w:
            x = g[n] * 32 / len(batch)
            past[n] += x * x
            w[n] -= m.RATE * x / np.sqrt(past[n])
    for n in w:
        assert np.abs(trainer.w[n] - w[n]).max() < 1e-3 and np.abs(trainer.sum[n] - past[n]).max() < 1e-3 * past[n].max()


# 4


def check_shards(rows, docs):
    shards, at = Counter(), defaultdict(list)
    for r in rows:
        shards[r["shard"]] += r["size"]
        at[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
    assert all(sorted(s) == list(range(len(s))) for s in at.values())
    if rows:
        even, most = sum(shards.values()) / 24, max(r["size"] for r in rows)
        assert all(abs(shards[s] - even) <= most + 1 for s in range(24))


def test_sharding(spark, documents, texts, edge, empty):
    rows = collected(sharding.shard(documents))
    check_shards(rows, documents)
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t)
    assert len(rows) == len(texts)
    got = collected(sharding.shard(edge))
    assert len(got) == edge.count()
    check_shards(got, edge)
    assert sharding.shard(empty).count() == 0
    hot = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    check_shards(collected(sharding.shard(hot)), hot)


@pytest.mark.parametrize("parts", [500_000, 5])
def test_equal_texts_share_a_shard(spark, parts):
    """Small groups stay whole, beside a hot text and many null ids; overfull ranges are subdivided by key."""
    rows = [(None if i % 3 else i, "hot" if i % 3 == 0 else f"text {i % 2500}") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = collected(sharding.shard(docs, rows_per_range=parts))
    check_shards(got, docs)
    where, size = defaultdict(set), Counter()
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
        size[r["text_crc32"]] += r["size"]
    share = sum(size.values()) / 24
    assert all(len(s) == 1 for t, s in where.items() if size[t] <= share / sharding.WHOLE)
    assert max(map(len, where.values())) > 1


# 5


def test_ann_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = defaultdict(list)
    for r in collected(ann.search(table)):
        rows[r["query_id"]].append(r)
    e = table.toPandas()
    x = np.stack(e["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q in e["vec_id"][e["vec_id"] % 50 == 0]:
        s = x @ x[e["vec_id"] == q][0]
        best = [i for i in np.lexsort((e["vec_id"], -s)) if e["vec_id"][i] != q][:5]
        got = sorted(rows[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]
        assert all(r["score"] == pytest.approx(s[e["vec_id"] == r["vec_id"]][0], abs=1e-12) for r in got)
        hit += len({e["vec_id"][i] for i in best} & {r["vec_id"] for r in got})
        total += 5
    assert hit / total >= 0.9


def test_ann_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (9, [-1.0, 0.0]), (50, [0.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit(1)).withColumn("id", F.lit("x"))
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in collected(ann.search(table))}
    assert [got[0, k] for k in range(1, 5)] == [1, 2, 50, 9] and (0, 5) not in got
    assert ann.search(table.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(400)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in collected(ann.search(copies))}
    assert [got[50, k] for k in range(1, 6)] == [0, 1, 2, 3, 4] and len(got) == 40


def test_ann_walks_are_one_row_a_query(spark, monkeypatch):
    """no table holds a query's vector once a leaf; queries in several parts give the same rows."""
    x = np.random.default_rng(4).normal(size=(1500, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    written, spool = [], ann.spool
    monkeypatch.setattr(ann, "spool", lambda df, name: written.append((name, out := spool(df, name))) or out)
    monkeypatch.setattr(ann, "unspool", lambda *tables: None)

    def got():
        return sorted(tuple(r) for r in ann.search(table, step=5).collect())

    one = got()
    assert {name: df.count() for name, df in written}["walks"] == 300 and all(df.count() <= 1500 for _, df in written)
    monkeypatch.setattr(ann, "QUERY_BYTES", 10_000)
    monkeypatch.setattr(ann, "PAIRS", 7)
    assert got() == one and len(one) == 1500


def test_ann_of_repeated_ids(spark):
    """Rows that repeat an id are queries and candidates each; against brute force."""
    rows = [(50, [1.0, 0.0]), (50, [0.9, 1.0]), (100, [0.0, 1.0])] + [(i, [math.cos(i), math.sin(i)]) for i in range(1, 15)] + [(3, [1.0, 0.1])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in collected(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))))
    want = []
    for k, (q, x) in enumerate(rows):
        if q % 50 == 0:
            near = sorted((-np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y), i) for j, (i, y) in enumerate(rows) if j != k)[:5]
            want += [(q, rank, i, round(-s, 9)) for rank, (s, i) in enumerate(near, 1)]
    assert got == sorted(want) and len(got) == 15


def test_workers_need_not_have_the_package(tmp_path):
    """A session started elsewhere, whose workers can't import the package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "run.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def there(batches):
    import importlib.util
    for b in batches:
        b["id"] = int(importlib.util.find_spec("tissuequery") is not None)
        yield b
assert spark.range(1).mapInPandas(there, "id long").first()[0] == 0
queries = __spark_entry__.queries()
for name in [n for n in queries if n.startswith("op")]:
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0, name
""")
    env = {k: x for k, x in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]


# 6


def test_token_counts(spark, documents, texts, edge, empty):
    model = bpe.encoder(open(bpe.default_file(), encoding="utf-8").read())
    rows = collected(token_counts.count_tokens(documents))
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: sum(len(c[0]) // 4 for c in model.plain(t or "")) for i, t in texts.items()}
    assert token_counts.count_tokens(edge).count() == edge.count()
    assert token_counts.count_tokens(empty).count() == 0


@pytest.mark.parametrize("kind, separator", [("<u2", 9), ("<u4", 70_009)])
def test_scan_across_blocks(spark, tmp_path, kind, separator):
    """Flat files on disk, read in blocks of 64 tokens: none, few, many and only separators, an unfinished tail, no token."""
    rng = np.random.default_rng(3)
    files, want = [(str(tmp_path / "none"), 0)], []
    (tmp_path / "none").write_bytes(b"")
    for f in range(5):
        flat = np.where(rng.random(3000) < (0.0, 0.001, 0.02, 0.5, 1.0)[f], separator, 1).astype(kind)
        name = str(tmp_path / f"{f}")
        flat.tofile(name)
        files.append((name, flat.nbytes))
        ends = np.flatnonzero(flat == separator)
        starts = np.concatenate([[0], ends + 1])
        want += [(name, k, int(a), int(b - a), True) for k, (a, b) in enumerate(zip(starts, ends))]
        if starts[-1] < len(flat):
            want.append((name, len(ends), int(starts[-1]), int(len(flat) - starts[-1]), False))
    got = token_counts.scan(spark.createDataFrame(files, "file string, bytes long"), separator, kind, 64)
    assert sorted((r["file"], r["ordinal"], r["first_token"], r["n_tokens"], r["finished"]) for r in collected(got)) == sorted(want)


def test_block_of_separators(spark):
    """65,536 empty documents in one block: a row each, whose size doesn't depend on the block."""
    docs = spark.range(1 << 16).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")).coalesce(1)
    assert token_counts.count_tokens(docs).agg(F.count("*"), F.sum("n_tokens"), F.countDistinct("first_token")).first() == (1 << 16, 0, 1 << 16)


def test_wide_vocabulary(spark, tmp_path):
    """Ids above 65,535 take 32 bits, so none is taken for the separator."""
    spec = json.loads(open(bpe.default_file(), encoding="utf-8").read())
    ids = {t: i + 70_000 for t, i in spec["model"]["vocab"].items()}
    spec["model"]["vocab"] = ids
    for t in spec["added_tokens"]:
        t["id"] += 70_000
    (tmp_path / "wide.json").write_text(json.dumps(spec), encoding="utf-8")
    docs = spark.createDataFrame([(1, "some words here"), (2, ""), (3, "other words")], "doc_id long, text string")
    narrow, wide = ({r["doc_id"]: r["n_tokens"] for r in collected(token_counts.count_tokens(docs, path=p))} for p in (None, str(tmp_path / "wide.json")))
    assert wide == narrow and token_counts.token_type(120_000) == "<u4"


# 7


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in texts}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        both = Counter(j for x in s for j in where[x] if j > i)
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in texts}


def test_near_duplicates(documents, texts):
    rows = collected(minhash.near_duplicates(documents))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_hot_group(spark):
    """A large group of edited copies, a second one near it, exact copies and a common passage."""
    rng = np.random.default_rng(4)
    texts, passage = {}, " ".join(f"p{i}" for i in range(60))
    for g in range(2):
        base = [f"b{i if i < 90 or not g else i + 1000}" for i in range(150)]
        for _ in range(160):
            w = list(base)
            for at in rng.choice(150, rng.integers(0, 8), replace=False):
                w[at] = rng.choice(["the", f"e{at}", f"x{rng.integers(50)}"])
            texts[len(texts)] = " ".join(w)
    for k in range(120):
        texts[len(texts)] = passage + " " + " ".join(f"r{k}_{i}" for i in range(rng.integers(5, 120)))
    for _ in range(80):
        texts[len(texts)] = "same words again and again here"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collected(minhash.near_duplicates(docs))}
    assert got == brute_components(texts)


def test_near_duplicates_edges(spark, edge, empty):
    rows = collected(minhash.near_duplicates(edge))
    assert len(rows) == edge.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["component_id"] == by[2]["component_id"] == by[9]["component_id"] == by[3]["component_id"] == 1
    assert by[4] == {"doc_id": 4, "n_shingles": 0, "component_id": 4, "kept": True} and by[5]["kept"] and by[8]["n_shingles"] == 0
    assert sorted((str(r["component_id"]), r["kept"]) for r in rows if r["doc_id"] is None) == [("1", False), ("None", True)]  # a copy of 1; no text
    one = minhash.deduplicated(edge)
    assert one.columns == edge.columns and sorted(r["doc_id"] for r in one.where("doc_id IS NOT NULL").collect()) == [1, 4, 5, 6, 7, 8, 10, 11, 12]
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    base, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "wv")
    rows = [(9, base), (9, other), (3, other + " x"), (5, base + " y"), (None, base), (None, "no id but six words here"), (None, "no id but six words here"), (7, ""), (9, None), (8, "A b"), (10, "a  B"), (11, base + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_kept", F.lit(1)).withColumn("a.b", F.lit(2))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in collected(minhash.near_duplicates(docs))), key=str)
    want = [(9, 56, 3, False), (9, 56, 3, False), (3, 57, 3, True), (5, 57, 3, False), (None, 56, 3, False), (None, 2, None, True), (None, 2, None, True), (7, 0, 7, True), (9, 0, 9, True), (8, 1, 8, True), (10, 1, 8, False), (11, 57, 3, False)]
    assert got == sorted(want, key=str)
    one = minhash.deduplicated(docs)
    assert one.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in collected(one)), key=str) == sorted([(3, other + " x"), (None, "no id but six words here"), (7, ""), (9, None), (8, "A b")], key=str)


def test_shared_passage_outside_the_common_set(spark):
    """Two fifths of a group share a passage that the rest lack: candidate pairs grow with the texts, not with their square."""

    def candidates(n):
        rng = np.random.default_rng(n)
        base, passage = list(range(1000, 1060)), list(range(5000, 5030))
        sets = [(k, -1 if k % 2 else k, np.unique(rng.choice(base, 40).tolist() + (passage if k % 5 < 2 else []) + rng.integers(10_000, 1 << 40, 40).tolist())) for k in range(n)]
        frame = spark.createDataFrame([(k, s.tolist()) for k, _, s in sets], "id long, members array<long>")
        under = spark.createDataFrame([(k, c, -1) for k, c, _ in sets], "a long, ca long, head long")
        core = spark.createDataFrame([(-1, k) for k, _, _ in sets[:64]], "head long, id long")
        pairs = {(r["a"], r["b"]) for r in minhash.left_over(under, core, frame, 75).collect()}
        for i, (k, c, x) in enumerate(sets):  # no similar pair of two components is lost
            for j, d, y in sets[:i]:
                both = len(np.intersect1d(x, y))
                if c != d and 100 * both >= 75 * (len(x) + len(y) - both):
                    assert (k, j) in pairs
        return len(pairs)

    assert candidates(400) <= max(3 * candidates(200), 400)


def test_hot_pivot_is_salted(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS_PER_SALT", 8)
    sets = spark.createDataFrame([(99, list(range(100)))] + [(k, list(range(k, 100))) for k in range(60)], "id long, members array<long>")
    pairs = spark.createDataFrame([(k, 99) for k in range(60)], "a long, b long")
    assert sorted(int(r["a"]) for r in minhash.confirm(pairs, sets).collect()) == list(range(26))


# 8


def test_classifier(spark, sf_dir, documents, edge, empty):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = collected(quality_classifier.classify(documents, labels))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    unseen = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert np.mean([r["predicted"] == known[r["doc_id"]] for r in unseen]) >= 0.85
    got = collected(quality_classifier.classify(edge, labels))
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.classify(empty, labels).count() == 0
    assert {r["score"] for r in collected(quality_classifier.classify(edge, labels.limit(0)))} == {0.5}
    kept = quality_classifier.accepted_documents(edge, labels)
    assert kept.columns == edge.columns


def test_classifier_scores_by_brute_force(spark, sf_dir, documents, texts):
    """The query's scores again, with an exact decomposition and a plain loop over neighbours."""
    q = quality_classifier
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    own = [i for i in sorted(labels) if zlib.crc32(str(i).encode()) % 5 and q.counts((texts[i] or "").encode()).any()]
    x = np.stack([q.counts((texts[i] or "").encode()) for i in own]).astype(float)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
    x = x * idf / np.linalg.norm(x * idf, axis=1, keepdims=True)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    p = vt[: q.LATENT].T
    z = x @ p
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = np.array([labels[i] for i in own])
    all_ = Counter(labels[i] for i in labels if zlib.crc32(str(i).encode()) % 5)
    stands = np.array([all_[c] / max(1, (y == c).sum()) for c in (0, 1)])[y]
    got = {r["doc_id"]: r["score"] for r in collected(q.op8_quality_classifier(spark, sf_dir))}
    off = []
    for i, t in texts.items():
        d = q.counts((t or "").encode()).astype(float) * idf
        if not d.any():
            assert got[i] == pytest.approx(all_[1] / sum(all_.values()))
            continue
        d = d / np.linalg.norm(d) @ p
        s = z @ (d / np.linalg.norm(d))
        at = np.argsort(-s, kind="stable")[: q.NEIGHBOURS]
        w = np.maximum(s[at], 0) ** q.SHARPNESS * stands[at]
        off.append(abs(got[i] - (w * y[at]).sum() / w.sum()))
    assert np.quantile(off, 0.95) < 0.02 and np.median(off) < 1e-3  # the randomised decomposition is near the exact one


def test_classifier_conflicts(spark):
    """Both labels teach nothing; of several texts one is learned from, whatever the order of rows."""
    docs = [(i, ("plain words " if i % 2 else "## && %% ") * (5 + i % 7)) for i in range(40)] + [(i, "another text " * i) for i in range(1, 9)] + [(99, "## && " * 9)]
    labels = [(i, i % 2) for i in range(40)] + [(99, 0), (99, 1), (99, None), (None, 1)]
    schema = "doc_id long, text string"
    runs = []
    for n in (1, 5):
        d = spark.createDataFrame(docs, schema).repartition(n, F.rand(n))
        rows = spark.createDataFrame(labels, "doc_id long, quality int").repartition(n, F.rand(n))
        assert 99 not in {i for i, _ in quality_classifier.sampled_labels(rows, 1000, 5, 0)[0]}
        runs.append(sorted((r["doc_id"], round(r["score"], 6)) for r in collected(quality_classifier.classify(d, rows))))
    assert runs[0] == runs[1]


def test_votes_are_those_of_brute_force():
    rng = np.random.default_rng(5)
    x = rng.random((40, quality_classifier.WIDTH)).astype(np.float32) * (rng.random((40, quality_classifier.WIDTH)) < 0.02)
    idf, projection = quality_classifier.latent_space(x, 8)
    z = (x * idf) / np.linalg.norm(x * idf, axis=1, keepdims=True) @ projection
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = (np.arange(40) % 3 > 0).astype(np.float32)
    model = {"idf": idf, "projection": projection, "vectors": z, "labels": y, "weights": np.ones(40, np.float32), "prior": 0.5}
    got = quality_classifier.vote(x, model, 5)
    for i in range(40):
        s = z @ z[i]
        at = np.argsort(-s)[:5]
        w = np.maximum(s[at], 0).astype(float) ** 4
        assert got[i] == pytest.approx((w * y[at]).sum() / w.sum(), abs=1e-4)


# 9


def test_licenses(spark, documents, texts, edge, empty):
    rows = collected(license_scan.scan_licenses(documents)) + [r | {"edge": 1} for r in collected(license_scan.scan_licenses(edge))]
    by_id = defaultdict(list)
    for r in edge.select("doc_id", "text").collect():
        by_id[r["doc_id"]].append(r["text"])
    assert len(rows) == len(texts) + edge.count()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in rows:
        candidates = by_id[r["doc_id"]] if "edge" in r else [texts[r["doc_id"]]]
        wants = []
        for t in candidates:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
            at = {v: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p, v in license_scan.PHRASES.items()}
            flat = sorted(x for own in at.values() for x in own)
            wants.append((len(w), len(flat), flat[0] if flat else None, flat[-1] if flat else None, ",".join(sorted(v for v, own in at.items() if own))))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) in wants
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert license_scan.scan_licenses(empty).count() == 0


def brute_licenses(text):
    """Every wording against every run of the text's words, by plain dynamic programming."""
    found, own = {}, license_scan.words_of((text or "").encode())
    for label, t in license_scan.TEMPLATES.items():
        w = license_scan.words_of(t.encode())
        row = [0] * (len(own) + 1)
        for i, x in enumerate(w, 1):
            new = [i]
            for j, y in enumerate(own):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        if min(row) <= len(w) * (1 - license_scan.COVERAGE) + 1e-9:
            found[label] = 1 - min(row) / len(w)
    return found


def test_license_labels_and_scores_by_brute_force(spark, documents):
    """Whole wordings, edited ones, near misses and documents: labels and scores of the query's own parameters."""
    mit, bsd = license_scan.TEMPLATES["mit-text"].split(), license_scan.TEMPLATES["bsd-3-text"]
    rows = ["x " + " ".join(mit) + " y", "foo released under the fine mit license bar", "released under a mit license", " ".join(w for i, w in enumerate(mit) if i % 5), " ".join(w for i, w in enumerate(mit) if i % 3), "licensed under cc by nc 3 0", "all rights are reserved", "ALL Rights-Reserved.", " ".join(mit[:60] + ["zz"] * 30 + mit[60:]), bsd, bsd.replace("binary forms", "some binary forms").replace("permitted ", ""), "this work is now licensed under a gnu general public license version", "work licensed under", None, ""]
    rows += [r["text"] for r in documents.where("length(text) < 2500").select("text").collect()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(None, rows[0])], "doc_id long, text string")
    some = 0
    for r in collected(license_scan.scan_licenses(docs)):
        want = brute_licenses(rows[r["doc_id"] or 0])
        base = {x for x in r["base_labels"].split(",") if x}
        assert {x for x in r["labels"].split(",") if x} == base | set(want)
        assert r["score"] == pytest.approx(1.0 if base else max(want.values(), default=0.0))
        some += bool(want)
    assert some > 12


def test_license_spans_stand_where_they_say(spark):
    text = "x y " + license_scan.TEMPLATES["isc-text"] + " z"
    got = collected(license_scan.license_spans(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")))
    assert [(r["_label"], r["coverage"], r["first"], r["last"]) for r in got] == [("isc-text", 1.0, 2, len(license_scan.words_of(text.encode())) - 2)]


# 10


def library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def test_bpe_equals_the_library(spark, documents, edge, empty):
    rng = np.random.default_rng(6)
    alphabet = list("aAbeEinthIT's'reLL 0123٣²½ßẞİıΣσςé́ﬁ中か\t\n\x1c\x1d\x85\xa0 !?.,--<|>endoftxt\x00\U0001f600‍﻿")
    wild = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(1500)] + ["<|endoftext|>", "a<|startoftext|>B <|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "don't DON'T we'LL", "z" * 3000]
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(wild)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(more).union(edge.select("doc_id", "text"))
    own = collected(docs.select("text"))
    got = Counter((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in collected(bpe.encode_documents(docs)))
    assert got == Counter(library([r["text"] for r in own]))
    assert bpe.encode_documents(empty).count() == 0
    assert len(bpe.encode_documents(edge).columns) == 4


def test_bpe_of_all_unicode(spark):
    """Random code points from all planes, and all those in which Unicode versions differ."""
    rng = np.random.default_rng(9)
    odd = [chr(c) for t in (bpe.LATER_LETTERS, bpe.LATER_NUMBERS, bpe.LATER_MARKS) for a, b in bpe._ranges(t) for c in range(a, b + 1)] + [chr(c) for c in bpe._CAPITALS]
    wild = []
    for _ in range(3000):
        some = [chr(c) for c in rng.integers(1, rng.choice([0x3400, 0x110000]), 20) if not 0xD800 <= c < 0xE000]
        wild.append("".join(rng.permutation([*some, *rng.choice(odd, 10), *"ae B1", "\u00e9", "\u0301", "\u0323"])))
    docs = spark.createDataFrame(list(enumerate(wild)), "doc_id long, text string")
    got = Counter((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in collected(bpe.encode_documents(docs)))
    assert got == Counter(library(wild))
