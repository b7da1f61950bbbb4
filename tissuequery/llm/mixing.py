"""Operator 1: mixing sources to target weights (Efraimidis-Spirakis sampling, DataFrame functions only).

Every document gets an exponential key -ln(u)/weight from a hash of its id and text and its quality weight. A source's
target in words is met by complete epochs first; the rest is a weighted sample without replacement: the documents of
smallest key, in order, up to the remaining budget. The order within a source is found by levels, so no source, however
hot, is sorted in one task: prefix sums over fine key buckets find the bucket in which the budget ends; within it equal
documents (same id, same text) are counted before they are ordered; and among the equal documents at the cut the last one
taken is found by counts of blocks of rows.

Defined results: a null text has no words; a null source is a source of its own, last in order; a null id hashes like
the empty text; rows that repeat an id with other texts have keys of their own; rows equal in id and text are
interchangeable, and as many of them are taken as the budget holds; ties in the key go by id, text hash and row; a
document, of any length, is taken whole or not at all, so a source misses its target by half its longest document at
most; an empty table gives an empty result. Other columns, of any name, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import n_words, numbered, prefix_sums, read, row_of, small_side, spool, text_hash

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SYMBOLS = "#*$%&|<>"
_OCTAVE, _FINE = 16384, 1 << 20


def quality_weight(text: Column) -> Column:
    """1 for plain prose, less with the share of symbol characters, 0.05 at least."""
    length = F.length(text)
    share = (length - F.length(F.translate(text, SYMBOLS, ""))) / F.greatest(length, F.lit(1))
    return F.greatest(F.lit(0.05), F.coalesce(1 - 4.0 * share, F.lit(1.0)))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, size: Column, weight: Column, keep: list[Column]) -> DataFrame:
    """The kept columns with the source, the key and what breaks ties: id, text hash, row number."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    drawn = F.md5(F.concat_ws(":", name, F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    u = (F.conv(F.substring(drawn, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    out = docs.select(
        *keep,
        F.coalesce(F.col(source_col), F.lit("")).alias("_src"),
        F.col(source_col).isNull().cast("int").alias("_nul"),
        name.alias("_id"),
        text_hash(F.col(text_col)).alias("_th"),
        size.alias("_size"),
        (-F.log(u) / weight).alias("_key"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    fine = F.least(F.greatest(F.floor((F.log2("_key") + 32) * _OCTAVE), F.lit(0)), F.lit(_FINE - 1))
    return out.withColumn("_fine", fine.cast("long"))


def targets(totals: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """totals: _src, _nul, source_size. Adds target: all words shared by weight, capped at max_epochs times the source,
    the excess reshared. Sources sorted by size over weight, the capped ones come first; the shared rate is that at the
    first source which isn't capped. Places and sums are found by parts, so sources may be many."""
    t = numbered(totals, ["_nul", "_src"], "by_name")
    t = t.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_at") % len(weights) + 1).cast("int"))).drop("_at")
    t = numbered(t.withColumn("_ratio", F.col("source_size") / F.col("_w")).withColumn("_all", F.lit(0)), ["_ratio", "_nul", "_src"], "by_ratio")
    t = prefix_sums(t, ["_all"], "_at", ["source_size", "_w"])
    total, shares = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    t = t.withColumn("_rate", (F.lit(total) - max_epochs * F.col("source_size_before")) / (F.lit(shares) - F.col("_w_before")))
    capped = F.col("_rate") * F.col("_w") > float(max_epochs) * F.col("source_size")
    shared = t.agg(F.min_by(F.when(~capped, F.col("_rate")), F.when(~capped, F.col("_at")))).first()[0]
    return t.select("_src", "_nul", "source_size", F.when(capped, float(max_epochs) * F.col("source_size")).otherwise(F.lit(shared).cast("double") * F.col("_w")).alias("target"))


def _cuts(keyed: DataFrame, weights, max_epochs: int) -> DataFrame:
    """One row per source: size, target, complete epochs, and the bucket, key, id, text hash and row at which the sample
    ends. keyed is spooled, so row numbers are fixed."""
    where = ["_src", "_nul"]
    fine = keyed.groupBy(*where, "_fine").agg(F.sum("_size").alias("_size"))
    goal = targets(fine.groupBy(*where).agg(F.sum("_size").alias("source_size")), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long")
    goal = goal.withColumn("_epochs", epochs).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    goal = spool(goal, "sources")
    before = prefix_sums(fine, where, "_fine", ["_size"])
    crossing = before.join(small_side(goal), where).where((F.col("_rest") > 0) & (F.col("_size_before") < F.col("_rest")) & (F.col("_rest") <= F.col("_size_before") + F.col("_size")))
    crossing = spool(crossing.select(*where, "_fine", "_size_before", "_rest"), "crossing")
    # equal documents of the crossing bucket are one row each, with their number
    same = ["_key", "_id", "_th", "_size"]
    inside = keyed.join(small_side(crossing), [*where, "_fine"])
    groups = inside.groupBy(*where, "_fine", "_size_before", "_rest", *same).agg(F.count("*").alias("_n"))
    run = Window.partitionBy(*where, "_fine").orderBy(*same).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_from", F.col("_size_before") + F.coalesce(F.sum(F.col("_size") * F.col("_n")).over(run), F.lit(0)))
    # a document is taken while the budget's end is nearer behind it than before it
    room = F.when(F.col("_size") > 0, F.floor((F.col("_rest") - F.col("_from")) / F.col("_size") + 0.5)).otherwise(F.when(F.col("_from") <= F.col("_rest"), F.col("_n")).otherwise(0))
    groups = groups.withColumn("_takes", F.least(room, F.col("_n"))).where("_takes > 0")
    last = spool(groups.groupBy(*where, "_fine").agg(F.max(F.struct(*same, "_takes", "_n")).alias("_g")).select(*where, "_fine", "_g.*"), "last")  # a row a source
    # the row at which the last group ends: by blocks of rows, then within one block
    rows = inside.join(small_side(last.select(*where, "_fine", *same, "_takes")), [*where, "_fine", *same]).select(*where, "_takes", "_mid", F.shiftright("_mid", 33).alias("_block"))
    blocks = rows.groupBy(*where, "_takes", "_block").agg(F.count("*").alias("_many"))
    upto = Window.partitionBy(*where).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_had", F.coalesce(F.sum("_many").over(upto), F.lit(0))).where((F.col("_had") < F.col("_takes")) & (F.col("_takes") <= F.col("_had") + F.col("_many")))
    final = rows.join(small_side(spool(blocks.select(*where, "_block", "_had"), "blocks")), [*where, "_block"])
    final = final.withColumn("_k", F.col("_had") + F.row_number().over(Window.partitionBy(*where, "_block").orderBy("_mid"))).where("_k = _takes").select(*where, F.col("_mid").alias("_cut_mid"))
    cut = last.join(final, where).select(*where, F.col("_fine").alias("_cut_fine"), F.struct("_key", "_id", "_th", F.col("_cut_mid").alias("_mid")).alias("_cut"))
    crossed = crossing.select(*where, F.col("_fine").alias("_crossed"))  # nothing of this bucket may be taken
    return spool(goal.join(crossed, where, "left").join(cut, where, "left").withColumn("_cut_fine", F.coalesce("_cut_fine", "_crossed")), "cuts")


def _decide(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    here = F.struct("_key", "_id", "_th", "_mid")
    extra = (F.col("_fine") < F.col("_cut_fine")) | ((F.col("_fine") == F.col("_cut_fine")) & F.coalesce(here <= F.col("_cut"), F.lit(False)))
    return keyed.join(small_side(cuts), ["_src", "_nul"]).withColumn("copies", F.col("_epochs") + F.coalesce(extra, F.lit(False)).cast("long"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, weight: Column | None = None) -> DataFrame:
    """Per row of docs: its id, size, source_size, target, taken, copies."""
    weight = quality_weight(F.col(text_col)) if weight is None else weight
    keyed = spool(_keyed(docs, id_col, text_col, source_col, n_words(F.col(text_col)), weight, [F.col(id_col).alias("_doc")]), "keyed")
    out = _decide(keyed, _cuts(keyed, weights, max_epochs))
    return out.select(F.col("_doc").alias(id_col), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: docs' columns, every document as often as the mix takes it. The texts are written once beside
    their keys, which fixes the row numbers; a document is then compared with its source's cut, and no text is
    shuffled."""
    keyed = spool(_keyed(docs, id_col, text_col, source_col, n_words(F.col(text_col)), quality_weight(F.col(text_col)), [row_of(docs).alias("_row")]), "keyed")
    out = _decide(keyed, _cuts(keyed.drop("_row"), weights, max_epochs)).where("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("_row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS src, CASE WHEN source IS NULL THEN 1 ELSE 0 END AS nul,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    greatest(0.05, coalesce(1 - 4.0 * ((length(text) - length(translate(text, '#*$%&|<>', ''))) / greatest(length(text), 1)), 1.0)) AS w,
    ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u,
    coalesce(doc_id::VARCHAR, '') AS id, md5(coalesce(text, '')) AS th FROM documents),
s AS (SELECT src, nul, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY nul, src) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
q AS (SELECT *, row_number() OVER (ORDER BY source_size / w, nul, src) AS k,
  (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate FROM r),
g AS (SELECT *, CASE WHEN rate * w > 3.0::DOUBLE * source_size THEN 3.0::DOUBLE * source_size
  ELSE w * (SELECT arg_min(rate, k) FROM q WHERE NOT rate * w > 3.0::DOUBLE * source_size) END AS target FROM q),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS epochs FROM g),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
  sum(d.size) OVER (PARTITION BY d.nul, d.src ORDER BY -ln(d.u) / d.w, d.id, d.th ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.src = e.src AND d.nul = e.nul)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN rest > 0 AND (upto <= rest OR upto - rest <= rest - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken,
  (epochs + CASE WHEN rest > 0 AND (upto <= rest OR upto - rest <= rest - (upto - size)) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM p
"""
