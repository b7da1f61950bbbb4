"""Coefficients: mapping to cells, aggregation and ranking, derivatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of coefficients (some 100 bytes each) up to which they are broadcast, and the parts of a cluster beyond.
BROADCAST_ROWS, SALTS = 500_000, 64


def cell_rows(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """cell_idx, row_id: cells by cluster if every cell's cluster is a row, else by cell id for all cells (no row: null).

    rows: row_id, few."""
    labels = F.broadcast(rows.select("row_id").distinct())
    missing = cells.select(F.col("cluster").cast("string").alias("row_id")).distinct().join(labels, "row_id", "left_anti")
    key = F.col("cluster").cast("string") if missing.isEmpty() else F.col("cell_id")
    return cells.select("cell_idx", key.alias("row_id")).join(labels.withColumn("found", F.lit(True)), "row_id", "left").select("cell_idx", F.when(F.col("found"), F.col("row_id")).alias("row_id"))


def interactions(cells: DataFrame, betas: DataFrame) -> DataFrame:
    """target, term_type, a, b with mean, min, max, sum, mean of positive and mean of negative coefficients over cells.

    A cluster's coefficient counts once a cell: the cells are counted by cluster first, so nothing is expanded."""
    n = cells.groupBy("cluster").agg(F.count("*").alias("n"))
    b = betas.join(F.broadcast(n), "cluster")
    w = F.col("n") * F.col("beta")
    pos, neg = F.col("beta") > 0, F.col("beta") < 0
    out = b.groupBy("target", "term_type", "a", "b").agg(
        (F.sum(w) / F.sum("n")).alias("mean"), F.min("beta").alias("min"), F.max("beta").alias("max"), F.sum(w).alias("sum"),
        (F.sum(F.when(pos, w)) / F.sum(F.when(pos, F.col("n")))).alias("positive"), (F.sum(F.when(neg, w)) / F.sum(F.when(neg, F.col("n")))).alias("negative"),
    )
    return out


def term_name() -> Column:
    """A term's name without its prefix, of the columns term_type, a, b."""
    pair = F.when(F.col("term_type") == "lr", F.concat("a", F.lit("$"), "b")).when(F.col("term_type") == "tfl", F.concat("a", F.lit("#"), "b"))
    return F.coalesce(pair, F.when(F.col("term_type") == "intercept", "beta0").otherwise(F.col("a")))


def top_coefficients(cells: DataFrame, betas: DataFrame, selected: DataFrame, k: int) -> DataFrame:
    """The k terms of largest mean absolute coefficient over the selected cells (repeats count), ties by name."""
    n = selected.join(cells.select("cell_idx", "cluster"), "cell_idx").groupBy("cluster").agg(F.count("*").alias("n"))
    out = betas.join(F.broadcast(n), "cluster").groupBy(term_name().alias("term")).agg((F.sum(F.col("n") * F.col("beta")) / F.sum("n")).alias("mean"), (F.sum(F.col("n") * F.abs("beta")) / F.sum("n")).alias("mean_abs"))
    return out.select("term", F.round("mean", 9).alias("mean"), F.round("mean_abs", 9).alias("mean_abs")).orderBy(F.desc("mean_abs"), "term").limit(k)


def by_cluster(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Each cell with all rows of its cluster. Up to BROADCAST_ROWS rows are broadcast; more are joined by shuffle, each
    cluster's cells dealt to SALTS parts, so that a cluster that holds most cells is no single task."""
    if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return cells.join(F.broadcast(rows), "cluster")
    dealt = cells.withColumn("_salt", F.pmod(F.xxhash64("cell_idx"), F.lit(SALTS)).cast("int"))
    return dealt.join(rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["cluster", "_salt"]).drop("_salt")


def splash(cells: DataFrame, betas: DataFrame, expression: DataFrame, received_lr: DataFrame, received_tfl: DataFrame, scale: float = 1.0, cap: float | None = None, ligands: list[str] | None = None) -> DataFrame:
    """cell_idx, target, gene, deriv: derivatives of every target by its modulators. Absent values are 0; pairs whose
    ligand is not among `ligands`, the names with received signals (None: all), are dropped.

    Every term gives one or two contributions; those to the same gene add up, then the sum is clamped."""
    terms = betas.where("term_type != 'intercept'")
    if ligands is not None:
        terms = terms.where((F.col("term_type") == "tf") | F.col("a").isin(ligands))
    own = by_cluster(cells.select("cell_idx", "cluster"), terms)
    value = expression.select("cell_idx", F.col("gene").alias("b"), F.col("value").alias("e"))
    both = own.where("term_type != 'tf'").join(value, ["cell_idx", "b"], "left")
    lr = both.where("term_type = 'lr'").join(received_lr.select("cell_idx", F.col("gene").alias("a"), F.col("value").alias("rw")), ["cell_idx", "a"], "left")
    tfl = both.where("term_type = 'tfl'").join(received_tfl.select("cell_idx", F.col("gene").alias("a"), F.col("value").alias("rw")), ["cell_idx", "a"], "left")
    e, rw = F.coalesce("e", F.lit(0.0)), F.coalesce("rw", F.lit(0.0))

    def parts(df, of_b):
        return df.select("cell_idx", "target", F.explode(F.array(F.struct(F.col("b").alias("gene"), of_b.alias("v")), F.struct(F.col("a").alias("gene"), (F.col("beta") * e * scale).alias("v")))).alias("p")).select("cell_idx", "target", "p.gene", "p.v")

    all_ = own.where("term_type = 'tf'").select("cell_idx", "target", F.col("a").alias("gene"), F.col("beta").alias("v"))
    all_ = all_.union(parts(lr, F.when(e > 0, F.col("beta") * rw * scale).otherwise(0.0))).union(parts(tfl, F.col("beta") * rw * scale))
    deriv = F.sum("v")
    if cap is not None:
        deriv = F.greatest(F.least(deriv, F.lit(cap)), F.lit(-cap))
    return all_.groupBy("cell_idx", "target", "gene").agg(deriv.alias("deriv"))


def active_terms(betas: DataFrame) -> DataFrame:
    """The coefficients of terms that are not zero in every row."""
    kept = betas.groupBy("target", "term_type", "a", "b").agg(F.max(F.abs("beta")).alias("most")).where("most > 0").select("target", "term_type", "a", F.coalesce("b", F.lit("")).alias("k"))
    return betas.withColumn("k", F.coalesce("b", F.lit(""))).join(kept, ["target", "term_type", "a", "k"], "left_semi").drop("k")
