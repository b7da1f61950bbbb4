"""A dataset's interactive questions as DataFrames: a method for each of the viewer's data routes.

Limits belong to the features (searches, reports, a viewer's payload) and raise where too much is asked for."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import betas as B
from ..operators import context, neighbors, network, perturb, summaries, transition
from ..sources import files
from ..sources.config import Config
from ..sources.tables import cut

# The routes' limits and the names of aggregates.
GENE_LIMIT, FULL_LIMIT, INDEX_LIMIT, INTERACTION_LIMIT, FIELD_CELLS, MEAN_GENES = 10_000, 50_000, 250_000, 80_000, 40_000, 200
CONTEXT_PAIRS = 120
AGGREGATES = ("mean", "min", "max", "sum", "positive", "negative")
JOB_GROUP = "tissuequery-perturbation"


@dataclasses.dataclass
class Session:
    """cells, expression (sparse), genes (gene_idx, gene), network edges, coefficients by cluster, radii by ligand."""

    cells: DataFrame
    expression: DataFrame
    genes: DataFrame
    edges: DataFrame | None = None
    betas: DataFrame | None = None
    radii: dict[str, float] = dataclasses.field(default_factory=dict)
    settings: Config | None = None

    @classmethod
    def from_run(cls, folder: str, cells: DataFrame, expression: DataFrame, genes: DataFrame, edges: DataFrame | None = None, settings: Config | None = None) -> Session:
        """The session of a run's folder: its coefficient files, the one configured radius for every ligand of a term, its
        settings (the folder's own unless given). Raises where no file can be read, a file is by cell, or a cell's
        cluster has no coefficients."""
        spark = cells.sparkSession
        settings = Config.load(folder) if settings is None else settings
        read, errors = files.read_coefficients(spark, folder)
        read = cut(read)
        if read.isEmpty():
            raise ValueError("no coefficients in " + folder + "".join(f"; {r['path']}: {r['error']}" for r in errors.limit(3).collect()))
        if not read.where("row_kind != 'cluster'").isEmpty():
            raise ValueError("coefficients by cell; a session takes those by cluster")
        betas = read.select(F.col("row_id").cast("double").cast("int").alias("cluster"), "target", "term_type", "a", "b", "beta")
        if not cells.join(betas.select("cluster").distinct(), "cluster", "left_anti").isEmpty():
            raise ValueError("a cell's cluster has no coefficients")
        pairs = betas.where("term_type IN ('lr', 'tfl')").join(genes.select(F.col("gene").alias("a")), "a", "left_semi")
        radii = {r["a"]: settings.kernel.radius for r in pairs.select("a").distinct().collect()}
        return cls(cells, expression, genes, edges, betas, radii, settings)

    def _has(self, gene: str) -> None:
        if self.genes.where(F.col("gene") == gene).isEmpty():
            raise ValueError(f"no gene {gene}")

    def _of(self, target: str) -> DataFrame:
        if self.betas is None:
            raise ValueError("no coefficients")
        own = self.betas.where(F.col("target") == target)
        if own.isEmpty():
            raise ValueError(f"no coefficients of {target}")
        return own

    def meta(self) -> dict:
        """Counts and bounds; coordinates that are null or not finite are left out."""
        ok = neighbors.finite(self.cells, "x", "y").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        n = self.cells.agg(F.count("*"), F.countDistinct("cluster"), F.countDistinct("cell_type")).first()
        return {"n_cells": n[0], "n_genes": self.genes.count(), "n_clusters": n[1], "n_cell_types": n[2], "bounds": tuple(ok), "umap": "umap_x" in self.cells.columns, "coefficients": self.betas is not None}

    def spatial(self) -> DataFrame:
        return self.cells.select("cell_idx", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"))

    def umap(self) -> DataFrame:
        if "umap_x" not in self.cells.columns:
            raise LookupError("no embedding")
        return self.cells.select("cell_idx", F.col("umap_x").cast("float").alias("x"), F.col("umap_y").cast("float").alias("y"))

    def clusters(self) -> DataFrame:
        return self.cells.select("cell_idx", "cluster")

    def cell_type_codes(self) -> DataFrame:
        if "cell_type" not in self.cells.columns:
            raise LookupError("no cell types")
        return summaries.label_codes(self.cells)

    def find_genes(self, prefix: str = "", limit: int = 500) -> DataFrame:
        return self.genes.where(F.col("gene").startswith(prefix)).orderBy("gene_idx").limit(min(limit, GENE_LIMIT)).select("gene")

    def all_genes(self) -> DataFrame:
        if self.genes.count() > FULL_LIMIT:
            raise ValueError(f"more than {FULL_LIMIT} genes; search by prefix")
        return self.genes.orderBy("gene_idx").select("gene")

    def gene_expression(self, gene: str) -> DataFrame:
        self._has(gene)
        return summaries.gene_expression(self.cells, self.expression, gene)

    def coefficient_genes(self) -> DataFrame:
        if self.betas is None:
            raise ValueError("no coefficients")
        return self.betas.select(F.col("target").alias("gene")).distinct().orderBy("gene")

    def coefficient_terms(self, target: str) -> DataFrame:
        return self._of(target).select(B.term_name().alias("term")).distinct().orderBy("term")

    def coefficient_values(self, target: str, term: str) -> DataFrame:
        """cell_idx, beta: one coefficient on every cell, by its cluster; 0 without a row."""
        own = self._of(target).where(B.term_name() == term).select("cluster", "beta")
        if own.isEmpty():
            raise ValueError(f"no term {term}")
        return self.cells.select("cell_idx", "cluster").join(F.broadcast(own), "cluster", "left").select("cell_idx", F.coalesce("beta", F.lit(0.0)).alias("beta"))

    def top_coefficients(self, target: str, indices: list[int], k: int = 25) -> DataFrame:
        if len(indices) > INDEX_LIMIT:
            raise ValueError(f"more than {INDEX_LIMIT} cells")
        chosen = self.cells.sparkSession.createDataFrame([(i,) for i in indices], "cell_idx long")
        return B.top_coefficients(self.cells, self._of(target).where("term_type != 'intercept'"), chosen, 25 if k == 0 else min(k, 100))

    def interactions(self, aggregate: str = "mean", scope: dict | None = None, max_genes: int = 4096) -> tuple[DataFrame, int, bool]:
        """(rows by falling size, how many there were, whether they were cut): target, term_type, a, b, beta."""
        mode = aggregate.strip().lower()
        if mode not in AGGREGATES:
            raise ValueError("aggregate must be one of " + ", ".join(AGGREGATES))
        first = self.coefficient_genes().limit(max(1, min(max_genes, 4096))).withColumnRenamed("gene", "target")
        own = self.betas.where("term_type != 'intercept'").join(F.broadcast(first), "target", "left_semi")
        rows = B.interactions(self.scoped(scope), own).select("target", "term_type", "a", "b", F.col(mode).alias("beta"))
        rows = rows.where(F.col("beta").isNotNull() & ~F.isnan("beta") & (F.col("beta") != 0) & (F.abs("beta") < float("inf")))
        total = rows.count()
        return rows.orderBy(F.desc(F.abs("beta")), "target", "term_type", "a", "b").limit(INTERACTION_LIMIT), total, total > INTERACTION_LIMIT

    def cell_context(self, cell: int, k: int = 10, radius: float | None = None, threshold: float = 0.01) -> DataFrame:
        """Edges from a cell to its k nearest cells, or to those within a radius (500 at most); pairs are the best 120 by
        the sender's own expression."""
        near = neighbors.from_one(neighbors.finite(self.cells, "x", "y"), cell)
        if radius is not None:
            near = near.where(F.col("d2") <= radius * radius) if radius > 0 else near.limit(0)
        near = near.orderBy("d2", "j").limit(500 if radius is not None else max(1, min(k, 200)))
        own = self.expression.where(F.col("cell_idx") == cell).select("gene", F.col("value").alias("mean"))
        pairs = network.top_pairs(network.lr_pairs(self.edges), own, CONTEXT_PAIRS)
        return context.sender_edges(self.edges, self.expression, cell, near, threshold, pairs)

    def scoped(self, scope: dict | None) -> DataFrame:
        """Cells of {'indices': [...]}, {'category': code}, {'cell_type': label}, {'clusters': [...]} or None (all). An
        index out of range or an empty choice is an error."""
        if not scope:
            return self.cells
        (kind, wanted), = scope.items()
        if kind == "indices":
            ids = sorted(set(wanted))
            some = self.cells.join(F.broadcast(self.cells.sparkSession.createDataFrame([(i,) for i in ids], "cell_idx long")), "cell_idx", "left_semi")
            if some.count() != len(ids):
                raise ValueError("an index out of range")
        elif kind == "category":
            some = self.cells.join(self.cell_type_codes().where((F.col("code") == wanted) & (F.col("code") != 65535)).select("cell_idx"), "cell_idx", "left_semi")
        elif kind == "cell_type":
            some = self.cells.where(F.trim("cell_type") == wanted.strip()) if wanted.strip() else self.cells.limit(0)
        elif kind == "clusters":
            some = self.cells.where(F.col("cluster").isin(list(wanted)))
        else:
            raise ValueError(f"no scope {kind}")
        if some.isEmpty():
            raise ValueError("no cell in the scope")
        return some

    def perturbed(self, desired: dict[str, float], rounds: int = 4, scope: dict | None = None, **options) -> DataFrame:
        """cell_idx, gene, delta, simulated. Runs as a job group of its own, so that cancel() can stop it."""
        for gene in desired:
            self._has(gene)
        if self.settings is not None:
            p = self.settings.perturbation
            options = {"threshold": p.threshold, "scale": self.settings.kernel.scale, "beta_scale": p.beta_scale, "cap": p.beta_cap, "factor": p.grid_factor} | options
        spark = self.cells.sparkSession
        spark.sparkContext.setJobGroup(JOB_GROUP, "perturbation", True)
        wanted = self.scoped(scope).select("cell_idx", F.explode(F.array(*(F.struct(F.lit(g).alias("gene"), F.lit(float(v)).alias("desired")) for g, v in desired.items()))).alias("w")).select("cell_idx", "w.gene", "w.desired")
        try:
            return perturb.propagate(self.cells, self._dense(), self.betas, wanted, self.radii, max(1, min(rounds, perturb.MAX_ROUNDS)), **options)
        finally:  # later jobs of this thread are no part of the group
            for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                spark.sparkContext.setLocalProperty(name, None)

    def _dense(self) -> DataFrame:
        return summaries.dense(self.cells, self.expression, self.genes)

    def cancel(self) -> None:
        self.cells.sparkSession.sparkContext.cancelJobGroup(JOB_GROUP)

    def perturb_preview(self, gene: str, value: float, target: str, rounds: int = 4, scope: dict | None = None) -> DataFrame:
        self._has(target)
        return self.perturbed({gene: value}, rounds, scope).where(F.col("gene") == target).select("cell_idx", "delta")

    def perturb_summary(self, gene: str, value: float, rounds: int = 4, scope: dict | None = None) -> DataFrame:
        return perturb.summary(self.perturbed({gene: value}, rounds, scope))

    def umap_field(self, gene: str, value: float, rounds: int = 4, scope: dict | None = None, quick: bool = False, neighbors_: int = 30, temperature: float = 0.05, remove_null: bool = True, unit: bool = False, rescale: float = 1.0, grid_scale: float = 1.0, vector_scale: float = 0.85, threshold: float = 0.0) -> DataFrame:
        """The transition field of a perturbation on the embedding's grid; `quick` takes the input change alone."""
        self.umap()
        if self.cells.count() > FIELD_CELLS:
            raise ValueError(f"more than {FIELD_CELLS} cells")
        dense = self._dense()
        if quick:
            self._has(gene)
            hit = self.scoped(scope).select("cell_idx", F.lit(True).alias("hit"))
            change = perturb.quick_delta(dense.join(hit, "cell_idx", "left"), gene, value, F.coalesce("hit", F.lit(False)))
        else:
            change = self.perturbed({gene: value}, rounds, scope)
        moved = change.select("cell_idx", "gene", F.round(F.col("delta") * rescale, 3).alias("delta"))
        near = neighbors.nearest(self.cells, max(3, min(neighbors_, 500)), x="umap_x", y="umap_y").select("i", "j")
        corr = transition.correlations(near, transition.vectors(dense, "value"), transition.vectors(moved, "delta"))
        moves = transition.cell_vectors(self.cells, transition.probabilities(corr, max(temperature, 1e-6), remove_null), unit)
        return transition.grid_field(self.cells, moves, max(grid_scale, 1e-6), max(vector_scale, 1e-9), max(threshold, 0.0))

    def cluster_mean_expression(self, genes: list[str]) -> DataFrame:
        if len(genes) > MEAN_GENES:
            raise ValueError(f"more than {MEAN_GENES} genes")
        return summaries.cluster_means(self.cells, self.expression, genes)

    def label_clusters(self, labels: dict[int, str]) -> DataFrame:
        names = self.cells.sparkSession.createDataFrame(list(labels.items()), "cluster int, label string")
        return self.cells.select("cell_idx", "cluster").join(F.broadcast(names), "cluster", "left").select("cell_idx", F.coalesce("label", F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))).alias("label"))
