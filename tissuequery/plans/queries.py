"""The reference queries over the adapted tables. Floats are rounded, rows are tidy."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, display
from ..operators import betas as B
from ..operators import context, kernel, lasso, neighbors, network, perturb, summaries, training, transition
from ..sources import adapters as A
from ..sources.config import Config
from ..sources.tables import cut, read
from .train import Run

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RADIUS = 100.0
LIGANDS = [f"G{i:02d}" for i in range(A.LIGANDS)]
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


def _received(spark, d):
    return kernel.exact(A.cells(spark, d), A.expression(spark, d), LIGANDS, [RADIUS] * len(LIGANDS))


def _dense(spark, d):
    return summaries.dense(A.cells(spark, d), A.expression(spark, d), A.genes(spark))


@query
def received_ligands(spark: SparkSession, d: str) -> DataFrame:
    return _received(spark, d).select("cell_idx", "gene", r6("value"))


@query
def received_multi_radius(spark, d):
    radii = [50.0 + 25.0 * (i % 3) for i in range(A.LIGANDS)]
    return kernel.exact(A.cells(spark, d), A.expression(spark, d), LIGANDS, radii, threshold=0.05).select("cell_idx", "gene", r6("value"))


@query
def received_ligands_grid(spark, d):
    return kernel.on_grid(A.cells(spark, d), A.expression(spark, d), LIGANDS, RADIUS, 0.5).select("cell_idx", "gene", r6("value"))


@query
def gene_expression(spark, d):
    return summaries.gene_expression(A.cells(spark, d), A.expression(spark, d), "G05").select("cell_idx", r6("value"))


@query
def expression_profiles(spark, d):
    return A.expression(spark, d).where(F.col("cell_idx").isin(1, 2, 3, 5, 8, 13) & F.col("gene").isin("G01", "G02", "G03", "G40", "nope")).select("cell_idx", "gene", r6("value"))


@query
def genes_prefix(spark, d):
    return A.genes(spark).where(F.col("gene").startswith("G1")).orderBy("gene_idx").limit(5).select(F.col("gene_idx").cast("long").alias("gene_idx"), "gene")


@query
def genes_substring(spark, d):
    return A.genes(spark).where(F.lower("gene").contains("g2")).orderBy("gene_idx").limit(100).select("gene")


@query
def cluster_ids_cast(spark, d):
    v = F.element_at("embedding", 5).cast("double") * 100
    return A.embeddings(spark, d).select(F.col("vec_id").alias("cell_idx"), F.coalesce(F.round(v), F.lit(0.0)).cast("long").alias("rounded"), F.coalesce(v, F.lit(0.0)).cast("long").alias("truncated"))


@query
def cell_type_codes(spark, d):
    return summaries.label_codes(A.cells(spark, d)).select("cell_idx", F.col("code").cast("long").alias("code"))


@query
def label_clusters(spark, d):
    names = spark.createDataFrame([(0, "T cells"), (3, "B cells")], "cluster int, label string")
    return A.cells(spark, d).select("cell_idx", "cluster").join(F.broadcast(names), "cluster", "left").select("cell_idx", F.coalesce("label", F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))).alias("label"))


@query
def gene_means(spark, d):
    return summaries.gene_means(A.cells(spark, d), A.expression(spark, d), A.genes(spark)).select("gene", r6("mean"))


@query
def selection_mean(spark, d):
    some = A.cells(spark, d).where("cell_idx < 20")
    return summaries.gene_means(some, A.expression(spark, d), A.genes(spark).where("gene IN ('G03', 'G04')")).select("gene", r6("mean"))


@query
def cluster_means(spark, d):
    return summaries.cluster_means(A.cells(spark, d), A.expression(spark, d), ["G00", "G07", "G33", "absent"]).select(F.col("cluster").cast("long").alias("cluster"), "gene", r6("mean"), "n")


@query
def label_counts(spark, d):
    return summaries.label_counts(A.cells(spark, d))


@query
def majority_label(spark, d):
    return summaries.majority_label(A.cells(spark, d).withColumn("cell_type", F.concat(F.lit("t"), (F.col("cell_idx") % 4).cast("string")))).select(F.col("cluster").cast("long").alias("cluster"), "cell_type")


@query
def bounds(spark, d):
    return A.cells(spark, d).agg(*(F.round(f(c), 6).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))))


@query
def distinct_clusters(spark, d):
    return A.cells(spark, d).agg(F.countDistinct(F.col("cluster").cast("string")).alias("n"))


@query
def condition_groups(spark, d):
    named = F.when(F.col("cell_idx") % 5 == 0, "batch A / drug+B").when(F.col("cell_idx") % 5 == 1, "batch A _ drug B").when(F.col("cell_idx") % 5 == 2, " ").when(F.col("cell_idx") % 5 == 3, "...").otherwise(F.col("condition"))
    return summaries.condition_groups(A.cells(spark, d).withColumn("condition", named))


@query
def regulators(spark, d):
    return network.regulators(network.known(A.network(spark), A.genes(spark)))


@query
def lr_pairs_top(spark, d):
    means = summaries.gene_means(A.cells(spark, d), A.expression(spark, d), A.genes(spark)).select("gene", F.round("mean", 9).alias("mean"))
    return network.top_pairs(network.lr_pairs(A.network(spark)), means, 25).select("ligand", "receptor", "pair_order", r6("score"))


def _tfl(spark):
    edges = A.network(spark)
    chosen = network.lr_pairs(edges).select("ligand")
    return network.tfl_pairs(edges, network.regulators(edges), chosen, 0.2)


@query
def tfl_pairs(spark, d):
    return _tfl(spark).select("target", "ligand", "tf", r6("weight"), F.col("rank").cast("long").alias("rank"))


@query
def modulator_terms(spark, d):
    edges, targets = A.network(spark), A.genes(spark).where("gene_idx % 8 = 0").select(F.col("gene").alias("target"))
    return network.modulator_terms(network.regulators(edges), network.lr_pairs(edges), _tfl(spark), targets)


@query
def modulator_genes(spark, d):
    t = A.design_terms(spark)
    return t.select("target", F.explode(F.array("a", "b")).alias("gene")).where("gene IS NOT NULL").select("target", F.concat(F.lit("beta_"), "gene").alias("gene")).distinct()


@query
def priors_masks(spark, d):
    edges = A.network(spark)
    order = F.regexp_extract("target", "[0-9]+", 0).cast("int")
    priors = edges.where("edge_type = 'grn' AND edge_order % 3 = 0").where(order % 16 == 0).select("source", "target", F.concat(F.lit("type_"), (F.col("edge_order") % 2).cast("string")).alias("cell_type"))
    types = spark.range(A.CLUSTERS).select(F.col("id").alias("cluster"), F.concat(F.lit("type_"), (F.col("id") % 5).cast("string")).alias("cell_type"))
    return network.with_prior_masks(A.design_terms(spark), priors, types)


@query
def decode_terms(spark, d):
    t = A.design_terms(spark)
    name = F.concat(F.lit("beta_"), "a", F.when(F.col("term_type") == "lr", F.concat(F.lit("$"), "b")).when(F.col("term_type") == "tfl", F.concat(F.lit("#"), "b")).otherwise(""))
    named = t.select("target", name.alias("term"))
    a, b = codec.term_parts(F.col("term"))
    return named.select("target", "term", codec.term_kind(F.col("term")).alias("kind"), codec.displayed_kind(F.col("term")).alias("shown"), a.alias("a"), F.coalesce(b, F.lit("")).alias("b"))


@query
def cell_beta_map(spark, d):
    rows = A.betas(spark).select(F.col("cluster").cast("string").alias("row_id")).distinct()
    mapped = B.cell_rows(A.cells(spark, d), rows)
    one = A.betas(spark).where("target = 'G08' AND term_type = 'tf'").groupBy(F.col("cluster").cast("string").alias("row_id")).agg(F.max(F.struct("a", "beta")).alias("m"))
    return mapped.join(F.broadcast(one), "row_id", "left").select("cell_idx", "row_id", F.round(F.coalesce("m.beta", F.lit(0.0)), 6).alias("beta"))


@query
def interactions(spark, d):
    out = B.interactions(A.cells(spark, d), A.betas(spark))
    return out.select("target", "term_type", "a", F.coalesce("b", F.lit("")).alias("b"), *(r6(c) for c in ("mean", "min", "max", "sum", "positive", "negative")))


@query
def top_coefficients(spark, d):
    some = A.cells(spark, d).where("cell_idx < 40").select("cell_idx")
    return B.top_coefficients(A.cells(spark, d), A.betas(spark).where("target = 'G16'"), some.union(some.where("cell_idx < 5")), 10).select("term", r6("mean"), r6("mean_abs"))


def _splash(spark, d, cap=None):
    rw = _received(spark, d)
    return B.splash(A.cells(spark, d), A.betas(spark), A.expression(spark, d), rw, rw, 1.0, cap)


@query
def splash(spark, d):
    return _splash(spark, d).select("cell_idx", "target", "gene", r6("deriv"))


@query
def splash_capped(spark, d):
    return _splash(spark, d, 0.2).select("cell_idx", "target", "gene", r6("deriv"))


def _propagated(spark, d, rounds, scope=None):
    cells = A.cells(spark, d)
    wanted = cells.select("cell_idx", F.lit("G01").alias("gene"), F.lit(0.0).alias("desired"))
    if scope is not None:
        wanted = wanted.join(cells.where(scope).select("cell_idx"), "cell_idx", "left_semi")
    return perturb.propagate(cells, _dense(spark, d), A.betas(spark), wanted, dict.fromkeys(LIGANDS, RADIUS), rounds)


@query
def perturb_round1(spark, d):
    return _propagated(spark, d, 1).select("cell_idx", "gene", r6("delta"), r6("simulated"))


@query
def perturb_round2(spark, d):
    return _propagated(spark, d, 2).select("cell_idx", "gene", r6("delta"), r6("simulated"))


@query
def perturb_scoped(spark, d):
    return _propagated(spark, d, 1, F.col("cell_type") == "type_1").select("cell_idx", "gene", r6("delta"), r6("simulated"))


@query
def perturb_summary(spark, d):
    return perturb.summary(_propagated(spark, d, 1))


@query
def quick_delta(spark, d):
    return perturb.quick_delta(_dense(spark, d), "G10", 0.5, F.col("cell_idx") % 2 == 0).select("cell_idx", "gene", r6("delta"))


@query
def neighbor_counts(spark, d):
    return neighbors.neighbor_counts(A.cells(spark, d), RADIUS).select("cell_idx", F.col("cluster").cast("long").alias("cluster"), "n")


def _knn(spark, d, k=15):
    return neighbors.nearest(A.cells(spark, d), k, x="umap_x", y="umap_y")


@query
def knn_embedding(spark, d):
    return _knn(spark, d).select("i", "j", F.col("rank").cast("long").alias("rank"), r6("d2"))


@query
def knn_symmetric(spark, d):
    return neighbors.symmetric(neighbors.nearest(A.cells(spark, d), 6))


@query
def one_cell_knn(spark, d):
    return neighbors.from_one(A.cells(spark, d), 7).orderBy("d2", "j").limit(12).select("j", r6("d2"))


@query
def one_cell_radius(spark, d):
    return neighbors.from_one(A.cells(spark, d), 7).where(F.col("d2") <= 150.0 * 150.0).orderBy("d2", "j").limit(500).select("j", r6("d2"))


@query
def cell_context(spark, d):
    """Ligand-receptor edges from cell 7 to its near cells: both expressed, score sqrt(L R), 48 a neighbour at most,
    each with the ligand's most expressed factor in the sender."""
    near = neighbors.from_one(A.cells(spark, d), 7).orderBy("d2", "j").limit(10).select("j")
    return context.sender_edges(A.network(spark), A.expression(spark, d), 7, near).select("j", "ligand", "receptor", r6("score"), "tf")


@query
def moran_i(spark, d):
    e = _dense(spark, d).select("gene", "cell_idx", F.col("value").alias("e"))
    return neighbors.morans_i(e, neighbors.symmetric(neighbors.nearest(A.cells(spark, d), 6))).select("gene", r6("moran_i"))


@query
def moran_p(spark, d):
    """Permutation test of every gene, with the reference's 99 permutations."""
    e = _dense(spark, d).select("gene", "cell_idx", F.col("value").alias("e"))
    genes = [f"G{i:02d}" for i in range(A.GENES)]
    return neighbors.moran_permutations(e, neighbors.symmetric(neighbors.nearest(A.cells(spark, d), 6)), genes, 99).select("gene", r6("moran_i"), "p")


def _delta(spark, d):
    dense = _dense(spark, d)
    delta = perturb.quick_delta(dense, "G12", 0.0).withColumn("delta", F.when(F.col("gene") == "G20", 0.1).otherwise(F.col("delta")))
    return transition.vectors(dense, "value"), transition.vectors(delta, "delta")


def _corr(spark, d):
    return transition.correlations(_knn(spark, d).select("i", "j"), *_delta(spark, d))


@query
def pearson_edges(spark, d):
    return _corr(spark, d).select("i", "j", r6("corr"))


@query
def transition_probs(spark, d):
    return transition.probabilities(_corr(spark, d)).select("i", "j", r6("p"))


@query
def cell_vectors(spark, d):
    return transition.cell_vectors(A.cells(spark, d), transition.probabilities(_corr(spark, d))).select("cell_idx", r6("vx"), r6("vy"))


@query
def grid_field(spark, d):
    moves = cut(transition.cell_vectors(A.cells(spark, d), transition.probabilities(_corr(spark, d))))
    return transition.grid_field(A.cells(spark, d), moves).select("ix", "iy", r6("gx"), r6("gy"), r6("u"), r6("v"))


@query
def spatial_map_cells(spark, d):
    return summaries.spatial_map(A.cells(spark, d), 8, 8).select("cell_idx", F.col("cluster").cast("long").alias("cluster"), "i", "j", r6("value"))


def _design_long(spark, d):
    """target, cluster, cell_idx, term, term_type, x: factor, received ligand times receptor, or times factor."""
    rw = _received(spark, d).select("cell_idx", F.col("gene").alias("a"), F.col("value").alias("rw"))
    dense = cut(_dense(spark, d))
    t = A.design_terms(spark).select("target", "term_type", "a", "b")
    cells = A.cells(spark, d).select("cell_idx", "cluster")
    tf = dense.join(F.broadcast(t.where("term_type = 'tf'")), F.col("gene") == F.col("a")).select("target", "cell_idx", "a", "b", "term_type", F.col("value").alias("x"))
    two = dense.join(F.broadcast(t.where("term_type != 'tf'")), F.col("gene") == F.col("b")).join(rw, ["cell_idx", "a"]).select("target", "cell_idx", "a", "b", "term_type", (F.col("rw") * F.col("value")).alias("x"))
    return tf.union(two).join(cells, "cell_idx"), dense


@query
def design_matrix(spark, d):
    long, _ = _design_long(spark, d)
    return long.select("target", "cell_idx", "term_type", "a", F.coalesce("b", F.lit("")).alias("b"), r6("x"))


def _design(spark, d):
    long, dense = _design_long(spark, d)
    kind = F.when(F.col("term_type") == "tf", 0).when(F.col("term_type") == "lr", 1).otherwise(2)
    item = F.struct(kind.alias("g"), F.col("a"), F.coalesce("b", F.lit("")).alias("b"), F.col("x"))
    rows = long.groupBy("target", "cluster", "cell_idx").agg(F.array_sort(F.collect_list(item)).alias("t"))
    y = dense.select(F.col("gene").alias("target"), "cell_idx", F.col("value").alias("y"))
    return rows.join(y, ["target", "cell_idx"]).select("target", "cluster", "cell_idx", "y", F.transform("t", lambda s: s["x"]).alias("x"), F.transform("t", lambda s: s["g"].cast("long")).alias("groups"))


@query
def lasso_fit(spark, d):
    return lasso.fit_groups(_design(spark, d), l1=1e-4, group_reg=1e-4).select("target", "cluster", "n_cells", F.round("intercept", 4).alias("intercept"), F.size("coef").alias("terms"), F.round("r2", 4).alias("r2"), F.round("mse", 6).alias("mse"), "converged")


def _fits(spark, d):
    """Given coefficients, not fitted ones, so that SQL can follow: intercept 0.01 cluster, coefficients 0.001 times the place."""
    design = cut(_design(spark, d))
    fits = design.groupBy("target", "cluster").agg(F.max(F.size("x")).alias("n")).select("target", "cluster", (F.col("cluster") * 0.01).alias("intercept"), F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: i * F.lit(0.001)).alias("coef"))
    return lasso.predicted(design, fits)


@query
def predict_lasso(spark, d):
    return _fits(spark, d).select("target", "cell_idx", r6("y"), r6("y_hat"))


@query
def fit_quality(spark, d):
    return lasso.quality(_fits(spark, d)).select("target", F.col("cluster").cast("long").alias("cluster"), "n", r6("mse"), F.round("r2", 5).alias("r2"))


def _gate(spark):
    g = A.genes(spark).withColumn("i", F.col("gene_idx"))
    inputs = g.select("gene", (F.col("i") % 17 == 0).alias("skip"), (F.col("i") % 13 == 0).alias("force"), (F.col("i") * 7 % 200).alias("min_cells"), (F.col("i") % 9 != 0).alias("converged"), (F.col("i") * 11 % 40 / 100.0).alias("mean_r2"), (F.col("i") * 5 % 60).alias("n_mods"), (F.col("i") * 5 % 60 / 2).alias("n_spatial"), (F.col("i") * 3 % 20 / 100.0 + 0.001).alias("p"))
    return summaries.gate(inputs)


@query
def gate_decision(spark, d):
    return _gate(spark).select("gene", "use", "reason", r6("rank_score"))


@query
def rank_top_k(spark, d):
    return _gate(spark).where(F.col("use")).select("gene", r6("rank_score")).orderBy(F.desc("rank_score"), "gene").limit(7)


@query
def scaled_by_cluster(spark, d):
    return summaries.scaled_by_cluster(A.cells(spark, d), summaries.gene_expression(A.cells(spark, d), A.expression(spark, d), "G05")).select("cell_idx", r6("scaled"))


@query
def quantile_range(spark, d):
    v = summaries.gene_expression(A.cells(spark, d), A.expression(spark, d), "G05")
    return summaries.rank_quantiles(v, {"low": 0.02, "mid": 0.5, "high": 0.98}).select(r6("low"), r6("mid"), r6("high"))


@query
def pending_genes(spark, d):
    done = A.genes(spark).where("gene_idx % 3 = 0").select("gene")
    return A.genes(spark).join(done, "gene", "left_anti").select("gene")


@query
def training_rollup(spark, d):
    s = A.genes(spark).join(spark.range(A.CLUSTERS).select(F.col("id").alias("cluster"))).select("gene", "cluster", ((F.col("gene_idx") * 3 + F.col("cluster") * 7) % 50 / 50.0).alias("r2"), ((F.col("gene_idx") + F.col("cluster")) % 4 != 0).alias("converged"))
    return summaries.training_rollup(s).select("gene", "clusters", *(r6(c) for c in ("mean_r2", "min_r2", "max_r2", "converged")))


@query
def user_event_matrix(spark, d):
    """A second, small matrix: users as cells, event types as genes."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.col("user_id").alias("cell_idx"), F.col("event_type").alias("gene")).agg(F.round(F.sum("value"), 4).alias("value"))


@query
def supplier_part_matrix(spark, d):
    """A large sparse matrix: suppliers as cells, parts as genes."""
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("cell_idx"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))


@query
def name_rules(spark, d):
    p = read(spark, d, "part")
    price = F.col("p_retailprice") - 1000
    return p.select(
        "p_partkey", codec.sanitized_filename(F.col("p_type")).alias("file"), codec.sanitized_float(price).alias("value"), codec.half_up(F.col("p_retailprice"), 1).alias("rounded"), display.thousands(F.col("p_partkey") * 1000).alias("shown"),
        codec.finite_or_zero(F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).when(F.col("p_partkey") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))).alias("finite"), codec.as_label(F.when(F.col("p_size") > 10, F.col("p_size"))).alias("label"), codec.name_hash(F.col("p_brand")).alias("hash"),
    )


@query
def pair_names(spark, d):
    p = read(spark, d, "part")
    pair = F.concat("p_brand", F.when(F.col("p_partkey") % 4 == 0, "").otherwise(" $ "), F.when(F.col("p_partkey") % 4 == 1, " ").otherwise(F.col("p_type")))
    a, b = codec.pair_parts(pair, "$")
    file = F.concat(F.lit("/runs/x/"), F.translate("p_brand", "#", ""), F.when(F.col("p_partkey") % 2 == 0, "_betadata.feather").otherwise("_other.feather"))
    return p.select("p_partkey", a.alias("first"), b.alias("second"), codec.gene_of_file(file).alias("gene"))


@query
def interaction_labels(spark, d):
    t = A.design_terms(spark)
    name = F.concat(F.lit("beta_"), "a", F.when(F.col("term_type") == "lr", F.concat(F.lit("$"), "b")).when(F.col("term_type") == "tfl", F.concat(F.lit("#"), "b")).otherwise(""))
    return t.select("target", display.interaction_label(name).alias("label"))


@query
def value_ranges(spark, d):
    """The range of a coordinate, and the symmetric one of another."""
    low, high = display.value_range(A.cells(spark, d).select(F.col("x").alias("value")))
    left, right = display.symmetric_range(A.cells(spark, d).select(F.col("y").alias("value")))
    return spark.createDataFrame([(low, high, left, right)], "low double, high double, left double, right double").select(r6("low"), r6("high"), r6("left"), r6("right"))


@query
def lasso_prox(spark, d):
    """The proximal step on every row's vector, in two groups of 32."""
    groups = np.repeat([0, 1], 32)

    def run(batches):
        for pdf in batches:
            w = [lasso.prox(np.asarray(v, np.float64), 0.05, {0: 0.4, 1: 0.8}, groups) for v in pdf["embedding"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "first": [x[:32].sum() for x in w], "size": [np.abs(x).sum() for x in w], "zeros": [int((x == 0).sum()) for x in w]})

    return A.embeddings(spark, d).select("vec_id", "embedding").mapInPandas(run, "vec_id long, first double, size double, zeros long").select("vec_id", r6("first"), r6("size"), "zeros")


@query
def gated_fit(spark, d):
    """Fits of R2 below a limit become zero."""
    fits = lasso.quality(_fits(spark, d)).withColumn("r2", F.when(F.col("cluster") % 2 == 0, F.abs("r2")).otherwise(F.col("r2"))).withColumn("coef", F.array(F.lit(1.0), F.lit(2.0))).withColumn("intercept", F.lit(0.5))
    return lasso.gated(fits, 0.1).select("target", F.col("cluster").cast("long").alias("cluster"), F.round("r2", 5).alias("r2"), "intercept", F.element_at("coef", 2).alias("second"))


@query
def expression_columns(spark, d):
    return summaries.expression_table(A.cells(spark, d), A.expression(spark, d), ["G02", "G41", "absent"]).select("cell_idx", r6("G02"), r6("G41"), "absent")


@query
def listed_targets(spark, d):
    return summaries.target_genes(A.genes(spark), ["G40", "G03", "G21", "nope", "G60"], 3).select(F.col("gene_idx").cast("long").alias("gene_idx"), "gene")


@query
def condition_cells(spark, d):
    return A.cells(spark, d).where(F.col("condition") == "cond 1").select("cell_idx", "cell_id")


@query
def highlighted_cells(spark, d):
    return summaries.highlighted(A.cells(spark, d), ["type_1", "type_3"])


@query
def flat_map_rows(spark, d):
    return summaries.flat_maps(summaries.spatial_map(A.cells(spark, d), 8, 8), 8, 8).select("cell_idx", "column", r6("value"))


@query
def active_terms(spark, d):
    b = A.betas(spark).withColumn("beta", F.when(F.col("a") < "G05", 0.0).otherwise(F.col("beta")))
    return B.active_terms(b).select(F.col("cluster").cast("long").alias("cluster"), "target", "term_type", "a", F.coalesce("b", F.lit("")).alias("b"), r6("beta"))


@query
def signal_max(spark, d):
    e = A.expression(spark, d)
    return perturb.elementwise_max(e.where("gene < 'G04'"), e.where("gene BETWEEN 'G02' AND 'G05'").withColumn("value", F.col("value") - 0.1)).select("cell_idx", "gene", r6("value"))


@query
def masked_design(spark, d):
    """The design with the factors set to 0 that the cell types' priors don't allow."""
    edges = A.network(spark)
    priors = edges.where("edge_type = 'grn' AND edge_order % 3 = 0").select("source", "target", F.concat(F.lit("type_"), (F.col("edge_order") % 2).cast("string")).alias("cell_type"))
    types = spark.range(A.CLUSTERS).select(F.col("id").alias("cluster"), F.concat(F.lit("type_"), (F.col("id") % 5).cast("string")).alias("cell_type"))
    long, _ = _design_long(spark, d)
    return network.masked(long, network.with_prior_masks(A.design_terms(spark), priors, types)).select("target", "cell_idx", "term_type", "a", F.coalesce("b", F.lit("")).alias("b"), r6("x"))


@query
def pair_terms_only(spark, d):
    edges, targets = A.network(spark), A.genes(spark).where("gene_idx % 8 = 0").select(F.col("gene").alias("target"))
    return network.modulator_terms(network.regulators(edges), network.lr_pairs(edges), _tfl(spark), targets, use=("lr",))


@query
def lr_pair_keys(spark, d):
    return network.pair_keys(A.network(spark))


@query
def context_gene_set(spark, d):
    return network.context_genes(A.design_terms(spark), "G16")


@query
def channel_mean(spark, d):
    return summaries.gene_expression(A.cells(spark, d), A.expression(spark, d), "G09").agg(F.round(F.avg("value"), 6).alias("mean"))


@query
def all_correlations(spark, d):
    return transition.all_correlations(*_delta(spark, d), digits=6)


@query
def cross_products(spark, d):
    """What the fits of all targets are made of: each term's centred products with itself and the target."""
    cells, terms = A.cells(spark, d), A.design_terms(spark).select("target", "term_type", "a", "b")
    index = {g: i for i, g in enumerate(f"G{i:02d}" for i in range(A.GENES))}
    batch = [s for _, s in sorted(training.specs(terms.collect(), index, LIGANDS).items())]
    sums = training.summed(training.cell_table(cells, A.expression(spark, d), A.genes(spark), LIGANDS, RADIUS), batch)

    def run(s, cluster, n, mean, cross):
        return pd.DataFrame({"target": s["target"], "cluster": cluster, "term": s["names"], "n": n, "xx": np.diag(cross)[:-1], "xy": cross[:-1, -1]})

    long = training.each(sums, batch, run, "target string, cluster long, term string, n long, xx double, xy double")
    return long.select("target", "cluster", "term", "n", F.round("xx", 5).alias("xx"), F.round("xy", 5).alias("xy"))


def _run(spark, d, **more):
    return Run(A.cells(spark, d), A.expression(spark, d), A.genes(spark), A.network(spark), Config.parse("[lasso]\nl1 = 1e-4\ngroup = 1e-4"), **more)


def _priors(spark):
    priors = A.network(spark).where("edge_type = 'nichenet' AND edge_order % 7 = 0").select("source", "target", F.concat(F.lit("type_"), (F.col("edge_order") % 2).cast("string")).alias("cell_type"))
    types = spark.range(A.CLUSTERS).select(F.col("id").alias("cluster"), F.concat(F.lit("type_"), (F.col("id") % 5).cast("string")).alias("cell_type"))
    return priors, types


@query
def run_terms(spark, d):
    """A run's terms of all genes, where the priors' factors take the place of the network's."""
    priors, types = _priors(spark)
    return _run(spark, d, priors=priors, cluster_types=types).terms(A.genes(spark)).select("target", "term_type", "a", F.coalesce("b", F.lit("")).alias("b"))


@query
def train_all(spark, d):
    """The coefficients of all 64 genes, as their files hold them."""
    return training.coefficients(_run(spark, d).all_fits(A.genes(spark))).select("target", F.col("row_id").cast("long").alias("cluster"), "term", F.round("beta", 4).alias("beta"))


@query
def train_with_priors(spark, d):
    priors, types = _priors(spark)
    return training.coefficients(_run(spark, d, priors=priors, cluster_types=types, use=("tf",)).all_fits(A.genes(spark))).select("target", F.col("row_id").cast("long").alias("cluster"), "term", F.round("beta", 4).alias("beta"))


@query
def colours(spark, d):
    c = A.cells(spark, d)
    low, high = F.lit(-40.0), F.lit(60.0)
    maps = {n: display.rgb(F.col("x"), low, high, n) for n in ("viridis", "magma", "diverging")} | {"category": display.category_rgb(F.col("cluster"), A.CLUSTERS)}
    return c.select("cell_idx", *(F.concat_ws(",", v.cast("array<string>")).alias(n) for n, v in maps.items()), display.selectable(F.col("cluster"), [True, False, True], 9).alias("selectable"))


@query
def symmetric_by_cluster(spark, d):
    v = A.cells(spark, d).select("cell_idx", F.col("y").alias("value"))
    return summaries.scaled_by_cluster(A.cells(spark, d), v, symmetric=True).select("cell_idx", r6("scaled"))
