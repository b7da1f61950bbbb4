"""Operator 7: near-duplicates by circulant MinHash.

A document's distinct five-word shingles become 64-bit hashes. One permutation sigma maps them to a circle of 2^32
places; signature coordinate k is the minimum of a second permutation pi at sigma(x) + k, so two permutations, one
shifted round the circle, give all coordinates. Bands of ROWS coordinates are bucket keys.

A node is a text class: all rows with one word sequence (its 128-bit hash). Links are confirmed on the full sets,
without all pairs of a bucket: every class in a bucket is held against the bucket's pivot, its most central class; then
only classes of different components that meet in a bucket are held against each other, and of these only the pairs that
what they share with a common set leaves possible (see left_over). Pairs of one component need no look, since the result
is the components. Rows of one id are one document, so their classes are linked too. At similarity 0.75 all bands miss a
pair with probability 2e-5.

Defined results: a null or wordless text has no shingles and links with nothing, whatever its id; rows with a null id
take part by their texts (their component is the smallest id reachable, or null where there is none, and then they are
kept); rows that repeat an id with other texts are one document of several classes; repeated rows are copies; ties of
pivots go by hash and change no result; a text of any length is one set, built in its task; an empty table gives an
empty result. Other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bound_batches, by_value, read, row_of, small_side, spool, text_hash, unspool, worker_tables

by_value(__name__)

SHINGLE, BANDS, ROWS = 5, 40, 5
PERCENT = 75
#: Candidate classes up to this many are broadcast against the texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Pairs of one class in a task at most, about: a pivot with more has its set copied.
PAIRS_PER_SALT = 4096
#: Texts of a component from which its common set is taken; the results do not depend on it.
CORE = 64
WORD_CACHE = 200_000


class WordHash(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; a shorter text is one shingle; no words, none."""
    if not words:
        return np.empty(0, np.uint64)
    cache = worker_tables("words").setdefault("words", WordHash())
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(words) - size + 1 + i])
    return np.unique(out)


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys (documents x bands) of non-empty sets."""
    place = (mix64(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)  # sigma
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    coordinates = np.empty((bands * rows, len(sets)), np.uint32)
    x, y = np.empty_like(place), np.empty_like(place)
    for k in range(bands * rows):  # pi at every place shifted by k
        np.add(place, np.uint32(k), out=x)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            np.right_shift(x, np.uint32(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(factor), out=x)
        np.right_shift(x, np.uint32(16), out=y)
        np.bitwise_xor(x, y, out=x)
        coordinates[k] = np.minimum.reduceat(x, starts)
    keys = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b + 1, np.uint64)
        for r in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + coordinates[b * rows + r])
        keys[:, b] = key
    return keys


def _worded(batch: pa.RecordBatch, step: int = 64, most: int = 1 << 19):
    """Ids and words of some rows at a time: `step` of them, or fewer with long texts."""
    texts, start, size = batch.column("text").cast(pa.binary()), 0, 0
    lengths = [n or 0 for n in pc.binary_length(texts).to_pylist()]
    for i, n in enumerate(lengths):
        size += n
        if i + 1 == len(lengths) or i + 1 - start >= step or size >= most:
            yield batch.column("id").slice(start, i + 1 - start), [(t or b"").lower().split() for t in texts.slice(start, i + 1 - start).to_pylist()]
            start, size = i + 1, 0


def _cls(words: list[bytes]) -> bytes | None:
    return hashlib.md5(b" ".join(words)).digest() if words else None


def _pick(ident: Column, raw: Column, kind: T.DataType) -> Column:
    """What tells a row from all but its equals: id (null apart) and text hash, without nulls inside."""
    return F.struct(ident.isNull().alias("nul"), F.coalesce(ident, F.lit(0).cast(kind)).alias("id"), raw.alias("raw"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, row: Column | None = None) -> DataFrame:
    """id, raw (hash of the text), mid (the row's number, if given), cls (hash of the word sequence, null without words), n (shingles), keys (one a band)."""
    bound_batches(docs.sparkSession)
    row = F.lit(0).cast("long") if row is None else row
    narrow = docs.select(F.struct(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("raw"), row.alias("mid")).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for ids, texts in _worded(batch):
                sets = [shingles(w) for w in texts]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full], bands, rows).view(np.int64)):
                        keys[i] = row
                yield pa.RecordBatch.from_arrays([ids, pa.array(map(_cls, texts), pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "cls", "n", "keys"])

    out = narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, cls binary, n long, keys array<long>")
    return out.select("id.id", "id.raw", "id.mid", "cls", "n", "keys")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (the class) and its set of shingle hashes. wanted: pick, id, cls: a row of each class asked for."""
    kind = docs.select(F.col(id_col)).schema[0].dataType
    narrow = docs.select(F.col(text_col).alias("text"), _pick(F.col(id_col), text_hash(F.col(text_col)), kind).alias("pick")).join(small_side(wanted, BROADCAST_IDS), "pick").select(F.struct("id", "cls").alias("id"), "text")

    def run(batches):
        for batch in batches:
            for got, texts in _worded(batch):
                # a text of another class with the same id and hash is dropped here
                classes = got.field("cls").to_pylist()
                own = [i for i, w in enumerate(texts) if _cls(w) == classes[i]]
                sets = [shingles(texts[i]).view(np.int64) for i in own]
                offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield pa.RecordBatch.from_arrays([got.field("id").take(pa.array(own, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets) if sets else [], pa.int64()))], names=["id", "members"])

    # equal rows have equal sets: one is kept
    return narrow.mapInArrow(run, "id long, members array<long>").groupBy("id").agg(F.min("members").alias("members"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: joins by class and an intersection in the JVM. A class that is b
    in many pairs (a pivot) has its set copied, and its pairs dealt to the copies."""
    many = spool(pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_PER_SALT).cast("int").alias("_copies")).where("_copies > 1"), "hot")
    dealt = pairs.join(small_side(many), "b", "left").select("a", "b", F.when(F.col("_copies").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), F.col("_copies"))).cast("int").alias("_salt"))
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("_a"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("_b")).join(small_side(many), "b", "left")
    right = right.select("b", "_b", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)).alias("_salt"))
    joined = dealt.join(left, "a").join(right, ["b", "_salt"]).select("a", "b", (F.size("_a") + F.size("_b")).alias("n"), F.size(F.array_intersect("_a", "_b")).alias("both"))
    return joined.where((100 + percent) * F.col("both") >= percent * F.col("n")).select("a", "b")


def beside(shared: DataFrame, so_far: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts that share a bucket with another component (a, ca: its component) with the components that are
    largest in these buckets (head); any two texts of different components in one bucket meet under one head. And some
    texts of every head (head, id, n: how many), CORE at about and at least one, to find what its texts have in common."""
    named = shared.join(so_far, "id", "left").select("key", "id", "company", F.coalesce("component", "id").alias("component"))
    named = spool(named, "named")
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("many"))
    heads = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("many", "component")).alias("head")).where("parts > 1").select("key", F.col("head.component").alias("head"))
    under = spool(named.join(heads, "key").select(F.col("id").alias("a"), F.col("component").alias("ca"), "head").distinct(), "under")
    members = named.select(F.col("component").alias("head"), "id", "company").distinct()
    whole = members.join(under.select("head").distinct(), "head", "left_semi").groupBy("head").agg(F.count("*").alias("many"), F.max(F.struct("company", "id")).alias("c"))
    chance = F.pmod(F.xxhash64("id"), F.ceil(F.col("many") / CORE)) == 0
    core = members.join(whole, "head").where(chance | (F.col("id") == F.col("c.id"))).select("head", "id")
    return under, core


def common_sets(core: DataFrame, sets: DataFrame) -> DataFrame:
    """head, what more than half of its core's texts have (_b), and what at least two of them have, rarest first (_q)."""
    core = spool(core, "core")
    n = core.groupBy("head").agg(F.count("*").alias("n"))
    each = core.join(sets, "id").select("head", F.explode("members").alias("x")).groupBy("head", "x").agg(F.count("*").alias("k"))
    seen = each.where("k > 1").join(n, "head").groupBy("head", "n").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("s"))
    whole = F.filter("s", lambda e: 2 * e["k"] > F.col("n"))
    lone = core.join(n.where("n = 1"), "head").join(sets, "id").select("head", F.col("members").alias("_one"))  # a core of one text
    out = n.join(seen.select("head", F.transform(whole, lambda e: e["x"]).alias("_b"), F.transform("s", lambda e: e["x"]).alias("_q")), "head", "left").join(lone, "head", "left")
    none = F.array().cast("array<long>")
    return out.select("head", F.coalesce("_one", "_b", none).alias("_b"), F.coalesce("_q", none).alias("_q"))


def left_over(under: DataFrame, core: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that meet under a head and may be similar, without all pairs of a head's texts.

    P is the head's common set (any set would do; this one leaves least). Write A(u) for what text u has and P lacks.
    What u and m share is at most the smaller of their shares with P, plus what A(u) and A(m) share; and similar sets
    share percent of either. So either A(u) and A(m) share something (at least t(u) = percent of u less u's share with
    P), and then they do so among their first |A| - t + 1 places in one order for the whole head; or the shares with P
    alone must do, which holds for few sizes of m. Both are equi-joins. The order puts what many of the head's texts have
    last (a passage that part of them share), so texts meet by what is rare."""
    common = spool(common_sets(core, sets), "common")
    joined = under.join(sets.select(F.col("id").alias("a"), F.col("members").alias("_a")), "a").join(common, "head", "left")
    none = F.array().cast("array<long>")
    joined = joined.withColumn("_b", F.coalesce("_b", none)).withColumn("_q", F.coalesce("_q", none))
    own = F.array_except("_a", "_b")
    joined = joined.select("a", "ca", "head", F.size("_a").alias("na"), F.size(F.array_intersect("_a", "_b")).alias("both"), F.concat(F.sort_array(F.array_except(own, "_q")), F.array_intersect("_q", own)).alias("own"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("na") * percent / 100) - F.col("both"))
    group = joined.select("a", "ca", "head", "na", "both", F.slice("own", 1, F.greatest(F.size("own") - needed + 1, F.lit(0)).cast("int")).alias("extra"))
    group = spool(group, "group")
    rest = group.where("ca != head")
    theirs = group.select("head", F.col("a").alias("m"), F.col("na").alias("nm"), F.col("both").alias("bm"), F.col("ca").alias("cm"), F.col("extra").alias("extra_m"))
    mine = rest.select("head", F.col("a").alias("u"), F.col("na").alias("nu"), F.col("both").alias("bu"), F.col("ca").alias("cu"), "extra")
    apart = (F.col("cu") != F.col("cm")) & _near_size("nu", "nm", percent) & ((F.col("cm") == F.col("head")) | (F.col("u") < F.col("m")))
    shared = mine.select("head", "u", "nu", "cu", F.explode("extra").alias("x")).join(theirs.select("head", "m", "nm", "cm", F.explode("extra_m").alias("x")), ["head", "x"]).where(apart).select("u", "m")
    low = F.ceil(F.col("nu") * percent / 100).cast("int")
    high = F.least(F.floor((100 + percent) * F.col("bu") / percent) - F.col("nu"), F.floor(F.col("nu") * 100 / percent)).cast("int")
    sized = mine.where(low <= high).select("head", "u", "nu", "cu", F.explode(F.sequence(low, high)).alias("nm"))
    alone = sized.join(theirs.select("head", "m", "nm", "cm", "bm"), ["head", "nm"]).where(apart & ((100 + percent) * F.col("bm") >= percent * (F.col("nu") + F.col("nm")))).select("u", "m")
    return shared.union(alone).select(F.greatest("u", "m").alias("a"), F.least("u", "m").alias("b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """id, component (its smallest id) of every id in links: alternating large and small stars, each round written to
    the shared folder; stops when a round changes nothing."""
    edges = spool(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        last, edges = edges, spool(small, "edges")
        unspool(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    member = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return member.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _near_size(a: str, b: str, percent: int):
    """Sets whose sizes differ more cannot be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _classified(docs: DataFrame, id_col: str, text_col: str, percent: int, bands: int, rows: int, row: Column | None = None) -> DataFrame:
    """Per row of docs: id, raw, mid, n and the class that stands for its component (node; null without words)."""
    sketch = spool(sketches(docs, id_col, text_col, bands, rows, row), "sketches")
    some = sketch.where(F.col("cls").isNotNull())
    # one row a class: its bands, one of its rows (the smallest), and a number, fixed by writing it
    kind = sketch.schema["id"].dataType
    classes = some.groupBy("cls").agg(F.min(_pick(F.col("id"), F.col("raw"), kind)).alias("pick"), F.first("keys").alias("keys"))
    classes = spool(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = classes.select("id", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    shared = spool(members.join(buckets, "key"), "shared")  # what has company in some bucket
    # a bucket's pivot is its most central text, that which has most company in all its buckets: an edited copy is
    # nearer to it than to another edited copy
    rank = shared.groupBy("id").agg(F.sum("many").alias("company"))
    ranked = spool(shared.drop("many").join(rank, "id"), "ranked")
    unspool(shared)
    pivots = ranked.groupBy("key").agg(F.max(F.struct("company", "id")).alias("pivot"))
    first = spool(ranked.join(pivots, "key").select(F.col("id").alias("a"), F.col("pivot.id").alias("b")).where("a != b").distinct(), "first")
    wanted = spool(classes.select("id", "cls", "pick").join(ranked.select("id").distinct(), "id", "left_semi"), "wanted")
    sets = spool(full_sets(docs, wanted, id_col, text_col), "sets")
    links = spool(confirm(first, sets, percent), "links")
    so_far = spool(components(links), "so_far")
    second = spool(left_over(*beside(ranked, so_far), sets, percent), "second")
    more = spool(confirm(second, sets, percent), "more")
    unspool(first, wanted, sets, ranked, second)
    # classes of one id are one document's
    ids = some.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("cls").alias("_least"), F.max("cls").alias("_most")).where("_least != _most").select("id", "_least")
    same = some.select("id", "cls").join(ids, "id").where("cls != _least").select("cls", "_least").distinct()
    numbers = classes.select("cls", F.col("id").alias("b"))
    same = same.join(numbers.select(F.col("cls").alias("_least"), "b"), "_least").join(numbers.select("cls", F.col("b").alias("a")), "cls").select("a", "b")
    extra = spool(more.union(same), "extra")
    whole = spool(components(links.union(extra)), "components") if not extra.isEmpty() else so_far
    named = whole.join(classes.select("id", "cls"), "id").join(classes.select(F.col("id").alias("component"), F.col("cls").alias("_root")), "component").select("cls", "_root")
    out = sketch.drop("keys").join(named, "cls", "left").select("id", "raw", "mid", "n", F.coalesce("_root", "cls").alias("node"))
    out = spool(out, "nodes")
    unspool(sketch, classes, links, more, extra, so_far, whole)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of docs: its id, n_shingles, component_id, kept."""
    nodes = _classified(docs, id_col, text_col, percent, bands, rows)
    least = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("component"), F.count("*").alias("_rows"))
    # a component of one row needs no join; the others' rows are few beside the corpus, and a hot one is pre-aggregated
    named = nodes.join(least.select("node", "component"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs' rows without near-duplicates, with docs' columns: of each component the row of smallest id (null last), then
    of smallest text hash, then the first; rows without words all stay. The rows are written once with their numbers, and
    the decisions come back by number, so no text is sorted or compared."""
    packed = docs.select(row_of(docs).alias("_row"), F.monotonically_increasing_id().alias("_mid"))
    packed = spool(packed, "rows")
    own = packed.select(F.col("_row").getField(id_col).alias("id"), F.col("_row").getField(text_col).alias("text"), "_mid")
    nodes = _classified(own, "id", "text", percent, bands, rows, F.col("_mid"))
    first = F.min(F.struct(F.col("id").isNull().alias("nul"), "id", "raw", "mid"))
    kept = nodes.where("node IS NOT NULL").groupBy("node").agg(first.alias("w")).select(F.col("w.mid").alias("_mid")).union(nodes.where("node IS NULL").select("mid"))
    return packed.join(small_side(spool(kept, "kept"), BROADCAST_IDS), "_mid", "left_semi").select("_row.*")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
