"""A training run: from a dataset to a coefficient file for each target, resumable."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lasso, network, summaries, training
from ..sources import files
from ..sources.config import Config
from ..sources.tables import cut


@dataclasses.dataclass
class Run:
    """cells (cell_idx, x, y, cluster), expression (cell_idx, gene, value), genes (gene_idx, gene), edges of the
    network; priors (source, target, cell_type) and cluster_types (cluster, cell_type) if there are any."""

    cells: DataFrame
    expression: DataFrame
    genes: DataFrame
    edges: DataFrame
    settings: Config = dataclasses.field(default_factory=Config)
    priors: DataFrame | None = None
    cluster_types: DataFrame | None = None
    use: tuple = ("tf", "lr", "tfl")

    def terms(self, targets: DataFrame) -> DataFrame:
        """target, term_type, a, b: the network's choice, or the priors' factors where a target has some."""
        own = network.known(self.edges, self.genes)
        regs, pairs = network.regulators(own), network.lr_pairs(own)
        if self.settings.kernel.max_lr_pairs is not None:
            means = summaries.gene_means(self.cells, self.expression, self.genes)
            pairs = network.top_pairs(pairs, means, self.settings.kernel.max_lr_pairs)
        tfl = network.tfl_pairs(own, regs, pairs.select("ligand"), self.settings.kernel.tf_ligand_cutoff)
        out = network.modulator_terms(regs, pairs, tfl, targets.select(F.col("gene").alias("target")), self.use)
        if self.priors is not None and "tf" in self.use:
            out = network.with_prior_factors(out, self._priors(targets))
        return training.known_terms(out, self.genes)

    def _priors(self, targets: DataFrame) -> DataFrame:
        return self.priors.join(targets.select(F.col("gene").alias("target")), "target", "left_semi")

    def masks(self, targets: DataFrame, terms: DataFrame) -> dict:
        """(target, cluster) to the factors that the cell type's list leaves out; targets' terms bound its size."""
        if self.priors is None or self.cluster_types is None or "tf" not in self.use:
            return {}
        out: dict = {}
        for r in network.with_prior_masks(terms, self._priors(targets), self.cluster_types).where("NOT allowed").select("target", "cluster", "a").distinct().toLocalIterator():
            out.setdefault((r["target"], int(r["cluster"])), set()).add(r["a"])
        return out

    def fits(self, targets: DataFrame):
        """The fits of the targets that have terms, gated by R2, a DataFrame for each batch of targets. A target's
        terms, not its cells, come to the driver."""
        own, s = cut(self.terms(targets)), self.settings
        index = {r["gene"]: r["gene_idx"] for r in self.genes.toLocalIterator()}
        ligands = sorted(r["a"] for r in own.where("term_type != 'tf'").select("a").distinct().collect())
        specs = training.specs(own.collect(), index, ligands, self.masks(targets, own))
        clusters = self.cells.where("cluster IS NOT NULL").select("cluster").distinct().count()
        if not specs or not clusters:
            return
        table = cut(training.cell_table(self.cells, self.expression, self.genes, ligands, s.kernel.radius, s.kernel.scale, s.kernel.grid_factor))
        for batch in training.batches(specs, clusters):
            got = training.fitted(training.summed(table, batch), batch, l1=s.lasso.l1, group_reg=s.lasso.group, iterations=s.lasso.iterations, tolerance=s.lasso.tolerance)
            yield [b["target"] for b in batch], lasso.gated(got, s.lasso.least_r2)

    def all_fits(self, targets: DataFrame) -> DataFrame:
        """The fits of all batches as one DataFrame."""
        spark, out = self.cells.sparkSession, None
        for _, got in self.fits(targets):
            out = got if out is None else out.union(got)
        return spark.createDataFrame([], training.FITS) if out is None else out


def pending(spark: SparkSession, folder: str, targets: DataFrame) -> DataFrame:
    """The targets without a coefficient file or an orphan's mark in the folder."""
    return targets.join(files.finished_genes(spark, folder), "gene", "left_anti")


def train(run: Run, folder: str, targets: DataFrame | None = None) -> DataFrame:
    """gene, status (done, orphan): trains what the folder does not hold yet and writes after each batch a coefficient
    file, or an orphan's mark where no term is left, and a log for every target. A file appears whole or not at all, so
    a stopped run goes on where it was; runs that share a folder may do a batch twice, with equal files."""
    spark = run.cells.sparkSession
    asked = (run.genes if targets is None else targets).select("gene")
    todo = cut(pending(spark, folder, asked))
    names = {r["gene"] for r in todo.toLocalIterator()}
    s = run.settings
    for batch, got in run.fits(todo):
        got = cut(got)
        written = set()
        for r in files.coefficient_files(training.coefficients(got)).toLocalIterator():
            files.write_bytes(spark, f"{folder}/{r['name']}", bytes(r["content"]))
            written.add(r["target"])
        for r in files.training_logs(got, s.lasso.iterations, s.lasso.tolerance).toLocalIterator():
            files.write_bytes(spark, f"{folder}/{r['name']}", r["content"].encode())
        for gene in batch:
            names.discard(gene)
            if gene not in written:
                files.write_bytes(spark, f"{folder}/{gene}.orphan", b"")
    for gene in sorted(names):  # targets without terms
        files.write_bytes(spark, f"{folder}/{gene}.orphan", b"")
    return asked.join(files.finished_genes(spark, folder), "gene")
