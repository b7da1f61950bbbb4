"""The model's tables from the generic test tables, as pure column expressions.

cells, expression, network, design terms and coefficients are deterministic in the rows of `embeddings`; the same rules
are written in SQL in plans/sql.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENES, LIGANDS, TARGET_STEP, CLUSTERS = 64, 8, 8, 10


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def gene_name(i) -> F.Column:
    return F.concat(F.lit("G"), F.lpad(i.cast("string"), 2, "0"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    def at(i, scale):
        return F.element_at("embedding", i).cast("double") * scale

    return embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("cell_idx"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("cell_id"), at(1, 1000).alias("x"), at(2, 1000).alias("y"), at(3, 10).alias("umap_x"), at(4, 10).alias("umap_y"),
        F.col("label").cast("int").alias("cluster"), F.concat(F.lit("type_"), (F.col("label") % 5).cast("string")).alias("cell_type"), F.concat(F.lit("cond "), (F.col("vec_id") % 3).cast("string")).alias("condition"),
    )


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse: cell_idx, gene, value > 0."""
    long = embeddings(spark, sf_dir).select(F.col("vec_id").alias("cell_idx"), F.posexplode("embedding").alias("i", "e"))
    return long.where("e > 0").select("cell_idx", gene_name(F.col("i")).alias("gene"), F.col("e").cast("double").alias("value"))


def genes(spark: SparkSession) -> DataFrame:
    return spark.range(GENES).select(F.col("id").cast("int").alias("gene_idx"), gene_name(F.col("id")).alias("gene"))


def network(spark: SparkSession) -> DataFrame:
    """source, target, edge_type, weight, edge_order: an arithmetic rule over all pairs of genes."""
    pairs = spark.range(GENES * GENES).select(F.col("id").alias("edge_order"), F.floor(F.col("id") / GENES).alias("i"), (F.col("id") % GENES).alias("j"))
    h = (7 * F.col("i") + 13 * F.col("j")) % 97
    kind = F.when(h < 10, "grn").when(h < 16, "lr").when(h < 40, "nichenet")
    return pairs.select(gene_name(F.col("i")).alias("source"), gene_name(F.col("j")).alias("target"), kind.alias("edge_type"), (h / 97.0).alias("weight"), "edge_order").where("edge_type IS NOT NULL")


def design_terms(spark: SparkSession) -> DataFrame:
    """target, term_type, a, b, ia, ib: transcription factors, ligand-receptor and ligand-TF pairs of every target."""
    pairs = spark.range(GENES * GENES).select(F.floor(F.col("id") / GENES).cast("int").alias("ia"), (F.col("id") % GENES).cast("int").alias("ib"))
    targets = spark.range(0, GENES, TARGET_STEP).select(F.col("id").cast("int").alias("t"))
    h = (7 * F.col("ia") + 13 * F.col("ib")) % 97
    named = pairs.withColumn("h", h)
    tf = named.where((F.col("h") < 10) & (F.col("ib") % TARGET_STEP == 0) & (F.col("ia") != F.col("ib"))).select(F.col("ib").alias("t"), F.lit("tf").alias("term_type"), "ia", F.lit(None).cast("int").alias("ib"))
    lr = named.where((F.col("h") >= 10) & (F.col("h") < 16) & (F.col("ia") < LIGANDS)).join(F.broadcast(targets), (F.col("t") + F.col("ia") + F.col("ib")) % 4 == 0).where("t != ia AND t != ib").select("t", F.lit("lr").alias("term_type"), "ia", "ib")
    tfl = named.where((F.col("h") >= 16) & (F.col("h") < 40) & (F.col("ia") < LIGANDS)).join(F.broadcast(targets), (F.col("t") + F.col("ia") + F.col("ib")) % 8 == 1).where("t != ia AND t != ib").select("t", F.lit("tfl").alias("term_type"), "ia", "ib")
    terms = tf.union(lr).union(tfl)
    return terms.select(gene_name(F.col("t")).alias("target"), "term_type", gene_name(F.col("ia")).alias("a"), gene_name(F.col("ib")).alias("b"), "t", "ia", "ib")


def betas(spark: SparkSession) -> DataFrame:
    """cluster, target, term_type, a, b, beta."""
    clusters = spark.range(CLUSTERS).select(F.col("id").cast("int").alias("cluster"))
    value = ((7 * F.col("ia") + 13 * F.coalesce("ib", F.lit(0)) + 3 * F.col("cluster") + 5 * F.col("t")) % 97) / 97.0 - 0.5
    return design_terms(spark).join(F.broadcast(clusters)).select("cluster", "target", "term_type", "a", "b", value.alias("beta"))
