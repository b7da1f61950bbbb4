"""Operator 4: sharding by sampled splitters (DataFrame functions only).

Records are ordered by the hash of their text, so equal texts stand together: they are one group. A size-weighted sample
of the hashes gives quantile boundaries; every group finds its range by binary search in the boundaries; overfull ranges
are subdivided by boundaries from a sample of their own. Prefix sums over the ranges, and a running sum over the groups
within each, give every group's place in the whole order, in bytes and in rows. Shards are cut at equal bytes. A group of
up to 1/WHOLE of a shard's share is never cut: it goes where its middle is. A larger one is cut between its rows, which
are numbered by counts of blocks of rows, so no hot text is ordered in one task. Slots count from each shard's first
record. The law is "bytes": shards differ by about 1/WHOLE of a share and one record's size.

Defined results: a null text has size 8 and the crc32 of the empty text, with which it is one group; null ids are ids like
others; rows of one text stand in the order of the table; two texts with one 64-bit hash would be one group, ordered by
size and row; a record of any length is placed by its middle, whole; with fewer records than shards some shards stay
empty; an empty table gives an empty result. Other columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import prefix_sums, read, small_side, spool, text_hash, unspool

SHARDS = 24
#: First ranges for each shard; a range of more than ROWS_PER_RANGE groups, or of OVERFULL times its share of the bytes, is
#: subdivided.
RANGES_PER_SHARD, ROWS_PER_RANGE, OVERFULL = 16, 500_000, 2
#: Sampled keys for each range or part of a range.
SAMPLES_PER_RANGE = 24
#: Groups up to this part of a shard's share stay in one shard.
WHOLE = 256
_PART = 1 << 20


def _sampled(groups: DataFrame, step: Column, salt: str) -> DataFrame:
    """Groups with _times: drawn size / step times in expectation, by a hash of the key."""
    u = F.pmod(F.xxhash64("_key", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    return groups.withColumn("_times", F.floor(F.col("_bytes") / step + u).cast("int")).where("_times > 0")


def _splitters(groups: DataFrame, total: int, ranges: int) -> list[int]:
    """Boundaries between the first ranges, from about ranges * SAMPLES_PER_RANGE keys whatever the table's size."""
    sample = _sampled(groups, F.lit(max(1.0, total / (ranges * SAMPLES_PER_RANGE))), "sample")
    weighed = sample.select("_key", F.explode(F.array_repeat(F.lit(1), F.col("_times"))))  # a group drawn many times weighs as much
    cuts = weighed.agg(F.percentile_approx("_key", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("cuts"))
    return sorted(set(cuts.first()["cuts"] or []))


def _search(table: Column, n: Column, bits: int) -> Column:
    """How many of the n sorted values in table are below or at the key: binary search."""

    def halve(at, step):
        nxt = at + step
        return F.when((nxt <= n) & (F.get(table, (nxt - 1).cast("int")) <= F.col("_key")), nxt).otherwise(at)

    steps = [1 << k for k in reversed(range(max(1, bits)))]
    return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), halve).cast("long")


def _ranged(groups: DataFrame, total: int, ranges: int, rows_per_range: int) -> DataFrame:
    """groups with _at: their range, or part of a range, as one number in the order of keys."""
    cuts = _splitters(groups, total, ranges)
    first = _search(F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>"), F.lit(len(cuts)), len(cuts).bit_length()) if cuts else F.lit(0).cast("long")
    groups = groups.withColumn("_range", first)
    share = max(1.0, total / ranges)
    stats = groups.groupBy("_range").agg(F.sum("_bytes").alias("_all_bytes"), F.count("*").alias("_groups"), F.max("_bytes").alias("_largest"))
    parts = F.greatest(F.ceil(F.col("_groups") / rows_per_range), F.when(F.col("_all_bytes") - F.col("_largest") > OVERFULL * share, F.ceil(F.col("_all_bytes") / share)).otherwise(1))
    stats = stats.select("_range", "_all_bytes", F.least(parts, F.col("_groups"), F.lit(_PART - 1)).cast("int").alias("_parts")).where("_parts > 1")
    # a sample of each overfull range's own: `ranges` rows, each with at most _parts boundaries
    over = groups.join(F.broadcast(stats), "_range")
    drawn = _sampled(over, F.greatest(F.lit(1.0), F.col("_all_bytes") / (F.col("_parts") * SAMPLES_PER_RANGE)), "part")
    bounds = drawn.groupBy("_range", "_parts").agg(F.sort_array(F.collect_list("_key")).alias("_keys"))
    chosen = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: F.get("_keys", F.floor(i * F.size("_keys") / F.col("_parts")).cast("int")))
    bounds = spool(bounds.select("_range", F.array_sort(F.array_distinct(chosen)).alias("_bounds")), "bounds")
    most = bounds.agg(F.coalesce(F.max(F.size("_bounds")), F.lit(0))).first()[0]
    if not most:
        return groups.withColumn("_at", F.col("_range") * _PART)
    part = F.when(F.col("_bounds").isNull(), 0).otherwise(_search(F.col("_bounds"), F.size("_bounds"), int(most).bit_length()))
    return groups.join(small_side(bounds), "_range", "left").withColumn("_at", F.col("_range") * _PART + part).drop("_bounds")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Per row of docs: its id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(F.col(id_col).alias("_doc"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), text_hash(text).alias("_key"), F.monotonically_increasing_id().alias("_mid"))
    sized = spool(sized, "sized").withColumn("_block", F.shiftright("_mid", 33))
    # blocks: a text's rows in one part of the table; a hot text has as many as there are parts
    blocks = sized.groupBy("_key", "_block").agg(F.count("*").alias("_rows"), F.sum("size").alias("_bytes"))
    upto = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = spool(blocks.select("*", F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_rows_in"), F.coalesce(F.sum("_bytes").over(upto), F.lit(0)).alias("_bytes_in")), "texts")
    groups = blocks.groupBy("_key").agg(F.sum("_rows").alias("_rows"), F.sum("_bytes").alias("_bytes"))
    total = groups.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    groups = spool(_ranged(groups, total, shards * RANGES_PER_SHARD, rows_per_range).withColumn("_all", F.lit(0)), "groups")
    ranges = groups.groupBy("_all", "_at").agg(F.sum("_bytes").alias("_bytes"), F.sum("_rows").alias("_rows"))
    ranges = prefix_sums(ranges, ["_all"], "_at", ["_bytes", "_rows"], _PART).select("_at", F.col("_bytes_before").alias("_b0"), F.col("_rows_before").alias("_r0"))
    run = Window.partitionBy("_at").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("_b", F.coalesce(F.sum("_bytes").over(run), F.lit(0))).withColumn("_r", F.coalesce(F.sum("_rows").over(run), F.lit(0)))
    placed = placed.join(small_side(spool(ranges, "ranges"), 1 << 20), "_at").select("_key", (F.col("_b0") + F.col("_b")).alias("_b"), (F.col("_r0") + F.col("_r")).alias("_r"), F.col("_bytes").alias("_group"))
    blocks = blocks.select("_key", "_block", "_rows_in", "_bytes_in").join(placed, "_key")
    within = Window.partitionBy("_key", "_block").orderBy("size", "_mid").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.select("*", F.count("*").over(within).alias("_k"), F.coalesce(F.sum("size").over(within), F.lit(0)).alias("_s")).join(blocks, ["_key", "_block"])
    whole = F.col("_group") * (WHOLE * shards) <= F.lit(total)
    middle = F.col("_b") + F.when(whole, F.col("_group") / 2).otherwise(F.col("_bytes_in") + F.col("_s") + F.col("size") / 2)
    rows = rows.select("_doc", "size", "text_crc32", F.least(F.floor(middle * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int").alias("shard"), (F.col("_r") + F.col("_rows_in") + F.col("_k")).alias("_g"))
    rows = spool(rows, "ordered")
    unspool(groups)
    first = rows.groupBy("shard").agg(F.min("_g").alias("_first"))  # one row a shard
    return rows.join(F.broadcast(first), "shard").select(
        F.col("_doc").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_g") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))
