"""Selection of modulators from the network, for all targets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP_LIGANDS_PER_TF = 5


def known(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """Edges with both ends among the genes (null ends dropped)."""
    g = F.broadcast(genes.select("gene"))
    return edges.join(g.withColumnRenamed("gene", "source"), "source", "left_semi").join(g.withColumnRenamed("gene", "target"), "target", "left_semi")


def regulators(edges: DataFrame) -> DataFrame:
    """target, tf, tf_order: distinct regulators other than the target, by first appearance."""
    own = edges.where("edge_type = 'grn' AND source != target")
    return own.groupBy("target", F.col("source").alias("tf")).agg(F.min("edge_order").alias("tf_order"))


def lr_pairs(edges: DataFrame) -> DataFrame:
    """ligand, receptor, pair_order: distinct pairs by first appearance."""
    return edges.where("edge_type = 'lr'").groupBy(F.col("source").alias("ligand"), F.col("target").alias("receptor")).agg(F.min("edge_order").alias("pair_order"))


def top_pairs(pairs: DataFrame, means: DataFrame, k: int) -> DataFrame:
    """The k pairs of largest mean expression 0.5 * (ligand + receptor), earlier pairs first; a missing gene is 0."""
    m = means.select("gene", "mean")
    scored = pairs.join(m.select(F.col("gene").alias("ligand"), F.col("mean").alias("ml")), "ligand", "left").join(m.select(F.col("gene").alias("receptor"), F.col("mean").alias("mr")), "receptor", "left")
    score = F.round(0.5 * (F.coalesce("ml", F.lit(0.0)) + F.coalesce("mr", F.lit(0.0))), 9)
    return scored.select("ligand", "receptor", "pair_order", score.alias("score")).orderBy(F.desc("score"), "pair_order").limit(k)


def tfl_pairs(edges: DataFrame, regulators_: DataFrame, ligands: DataFrame, cutoff: float) -> DataFrame:
    """target, ligand, tf: for each regulator of a target the five strongest links above the cutoff whose ligand is
    chosen, earlier edges first; repeated edges count."""
    links = edges.where((F.col("edge_type") == "nichenet") & (F.col("weight") > cutoff)).join(F.broadcast(ligands.select(F.col("ligand").alias("source")).distinct()), "source", "left_semi")
    by = Window.partitionBy("target").orderBy(F.desc("weight"), "edge_order")
    best = links.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= TOP_LIGANDS_PER_TF)
    best = best.select(F.col("target").alias("tf"), F.col("source").alias("ligand"), "weight", "rank")
    return regulators_.select("target", "tf").join(best, "tf").where("ligand != target")


def modulator_terms(regs: DataFrame, pairs: DataFrame, tfl: DataFrame, targets: DataFrame, use=("tf", "lr", "tfl")) -> DataFrame:
    """target, term_type, a, b of all targets; a pair that holds the target itself is dropped."""
    lr = pairs.join(F.broadcast(targets.select("target"))).where("ligand != target AND receptor != target")
    out = regs.join(F.broadcast(targets), "target", "left_semi").select("target", F.lit("tf").alias("term_type"), F.col("tf").alias("a"), F.lit(None).cast("string").alias("b"))
    out = out.union(lr.select("target", F.lit("lr"), "ligand", "receptor")).union(tfl.join(F.broadcast(targets), "target", "left_semi").select("target", F.lit("tfl"), "ligand", "tf"))
    return out.where(F.col("term_type").isin(*use))


def with_prior_masks(terms: DataFrame, priors: DataFrame, cluster_types: DataFrame) -> DataFrame:
    """terms x clusters with allowed: a cluster whose type has a list for the target allows only its factors."""
    listed = priors.select("target", "cell_type").distinct().withColumn("listed", F.lit(True))
    named = terms.where("term_type = 'tf'").join(F.broadcast(cluster_types)).join(listed, ["target", "cell_type"], "left")
    p = priors.select("target", "cell_type", F.col("source").alias("a")).distinct().withColumn("has", F.lit(True))
    out = named.join(p, ["target", "cell_type", "a"], "left")
    return out.select("target", "a", "cluster", (F.col("listed").isNull() | F.col("has").isNotNull()).alias("allowed"))


def with_prior_factors(terms: DataFrame, priors: DataFrame) -> DataFrame:
    """terms (target, term_type, a, b) where a target with priors of any cell type has those factors instead of the
    network's, and of its ligand-factor pairs those whose factor is listed. Other targets and pairs stay."""
    listed = priors.join(terms.select("target").distinct(), "target", "left_semi").select("target", F.col("source").alias("f")).distinct()
    has = listed.select("target").distinct().withColumn("_has", F.lit(True))
    factor = F.when(F.col("term_type") == "tfl", F.col("b"))
    own = terms.select("target", "term_type", "a", "b").withColumn("f", factor).join(has, "target", "left").join(listed.withColumn("_in", F.lit(True)), ["target", "f"], "left")
    kept = own.where(F.col("_has").isNull() | (F.col("term_type") == "lr") | (F.col("term_type") == "tfl") & F.col("_in"))
    return kept.select("target", "term_type", "a", "b").union(listed.select("target", F.lit("tf"), "f", F.lit(None).cast("string")))


def masked(design: DataFrame, masks: DataFrame) -> DataFrame:
    """design (target, cluster, term_type, a, x, ...) with x = 0 where a factor isn't allowed in the cell's cluster.
    masks: with_prior_masks."""
    no = masks.where(~F.col("allowed")).select("target", F.col("cluster").cast("int").alias("cluster"), "a", F.lit("tf").alias("term_type"), F.lit(True).alias("_no")).distinct()
    out = design.join(no, ["target", "cluster", "a", "term_type"], "left")
    return out.withColumn("x", F.when(F.col("_no").isNull(), F.col("x")).otherwise(0.0)).drop("_no")


def pair_keys(edges: DataFrame) -> DataFrame:
    """pair: the distinct names of all ligand-receptor pairs."""
    return lr_pairs(edges).select(F.concat("ligand", F.lit("$"), "receptor").alias("pair"))


def context_genes(terms: DataFrame, target: str) -> DataFrame:
    """gene: a target and all genes of its terms."""
    own = terms.where(F.col("target") == target)
    every = own.select(F.explode(F.array("target", "a", "b")).alias("gene")).where("gene IS NOT NULL")
    return every.union(terms.sparkSession.createDataFrame([(target,)], "gene string")).distinct()
