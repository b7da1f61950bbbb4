"""Fits of many targets from cells, sparse expression and terms.

A cell is one row: its cluster, its expressed genes as sparse arrays and its received ligands as an array. Each task
makes all distinct columns of a batch of targets from its cells, a few at a time, and keeps their cross products by
cluster, or the rows themselves while they are the smaller of the two; these are merged in two steps. A fit takes its own
columns out of its cluster's products. So neither designs nor dense matrices are shuffled, and what a task holds
depends on the terms and clusters, not on the cells. Batches are cut so that it stays below BATCH_BYTES (a target alone
may exceed it).
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, lasso

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(lasso)

BATCH_BYTES = 64 << 20
ROWS = 1024  # cells made dense at a time
GROUPS = {"tf": 0, "lr": 1, "tfl": 2}
FITS = "target string, cluster int, n_cells long, intercept double, terms array<string>, coef array<double>, r2 double, mse double, iterations int, converged boolean"


def known_terms(terms: DataFrame, genes: DataFrame) -> DataFrame:
    """The terms whose names are all among the genes."""
    g = genes.select("gene").distinct()
    out = terms.select("target", "term_type", "a", "b").join(g.withColumnRenamed("gene", "target"), "target", "left_semi").join(g.withColumnRenamed("gene", "a"), "a", "left_semi")
    two = out.where("b IS NOT NULL").join(g.withColumnRenamed("gene", "b"), "b", "left_semi")
    return out.where("b IS NULL").select("target", "term_type", "a", "b").union(two.select("target", "term_type", "a", "b"))


def cell_table(cells: DataFrame, expression: DataFrame, genes: DataFrame, ligands: list[str], radius: float, scale: float = 1.0, factor: float | None = None) -> DataFrame:
    """cluster, gi, gv (sparse expression by gene_idx), rw (received signal in the order of ligands), a row a cell.
    genes: gene_idx, gene. Cells without a cluster are left out."""
    named = expression.join(genes.select("gene", "gene_idx"), "gene")
    own = named.groupBy("cell_idx").agg(F.collect_list(F.struct("gene_idx", "value")).alias("s"))
    out = cells.where("cluster IS NOT NULL").select("cell_idx", F.col("cluster").cast("int").alias("cluster")).join(own, "cell_idx", "left")
    empty = F.array().cast("array<double>")
    if ligands:
        received = kernel.received(cells, expression, ligands, [radius] * len(ligands), scale, None, factor)
        order = F.array_position(F.array(*map(F.lit, ligands)), F.col("gene"))
        rw = received.groupBy("cell_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), "value"))), lambda v: v["value"]).alias("rw"))
        out = out.join(rw, "cell_idx", "left")
    else:
        out = out.withColumn("rw", empty)
    return out.select("cluster", F.coalesce(F.col("s.gene_idx"), F.array().cast("array<int>")).cast("array<int>").alias("gi"), F.coalesce(F.col("s.value"), empty).alias("gv"), F.coalesce("rw", empty).alias("rw"))


def specs(terms: list, gene_index: dict[str, int], ligands: list[str], masks: dict | None = None) -> dict[str, dict]:
    """By target: names and groups of its columns and where they come from. terms: rows target, term_type, a, b;
    masks: (target, cluster) to the factors that are not allowed there."""
    at = {g: k for k, g in enumerate(ligands)}
    out: dict[str, dict] = {}
    by: dict[str, list] = {}
    for t in terms:
        by.setdefault(t["target"], []).append((GROUPS[t["term_type"]], t["a"], t["b"] or ""))
    for target, own in by.items():
        own = sorted(set(own))
        mark = {0: "", 1: "$", 2: "#"}
        out[target] = {
            "target": target, "y": gene_index[target], "names": [f"beta_{a}{mark[g]}{b}" for g, a, b in own], "groups": np.array([g for g, _, _ in own]),
            "gene": np.array([gene_index[b if g else a] for g, a, b in own]), "ligand": np.array([at[a] if g else -1 for g, a, b in own]),
            "blocked": {c: np.array([k for k, (g, a, _) in enumerate(own) if g == 0 and a in no]) for (t, c), no in (masks or {}).items() if t == target},
        }
    return out


def columns(batch: list[dict]) -> list[tuple[int, int]]:
    """(gene, ligand or -1) of all distinct columns of a batch, terms and targets."""
    return sorted({(int(s["y"]), -1) for s in batch} | {(int(g), int(l)) for s in batch for g, l in zip(s["gene"], s["ligand"])})


def places(spec: dict, at: dict) -> np.ndarray:
    """Where a target's terms and, last, the target itself are among the columns."""
    return np.array([at[int(g), int(l)] for g, l in zip(spec["gene"], spec["ligand"])] + [at[int(spec["y"]), -1]])


def batches(specs_: dict[str, dict], clusters: int) -> list[list[dict]]:
    """The targets in order, in batches whose cross products fit."""
    out, used = [], set()
    for name in sorted(specs_):
        own = set(columns([specs_[name]]))
        if not out or clusters * len(used | own) ** 2 * 8 > BATCH_BYTES:
            out.append([])
            used = set()
        out[-1].append(specs_[name])
        used |= own
    return out


def grown(held, z: np.ndarray):
    """What a target and cluster hold, with more rows (the last column is the target): rows while they are no more than
    half of the cross products, then moments."""
    if isinstance(held, tuple):
        return lasso.merged(held, lasso.moments(z[:, :-1], z[:, -1]))
    z = z if held is None else np.vstack([held, z])
    return z if 2 * len(z) <= z.shape[1] + 1 else lasso.moments(z[:, :-1], z[:, -1])


def joined(a, b):
    """Two of them together."""
    if a is None or isinstance(b, np.ndarray):
        return b if a is None else grown(a, b)
    return lasso.merged(lasso.moments(a[:, :-1], a[:, -1]) if isinstance(a, np.ndarray) else a, b)


def packed(held) -> tuple[int, bytes, bytes]:
    """(n, mean, cross) as bytes: of moments the upper triangle, of rows no mean and the rows."""
    if isinstance(held, np.ndarray):
        return len(held), b"", held.tobytes()
    n, mean, cross = held
    return n, mean.tobytes(), cross[np.triu_indices(len(mean))].tobytes()


def unpacked(n: int, mean: bytes, cross: bytes):
    if not mean:
        return np.frombuffer(cross).reshape(n, -1)
    m = np.frombuffer(mean)
    full = np.zeros((len(m), len(m)))
    full[np.triu_indices(len(m))] = np.frombuffer(cross)
    return int(n), m, full + np.triu(full, 1).T


def moments_of(n: int, mean: bytes, cross: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """The moments of a row of summed."""
    held = unpacked(n, mean, cross)
    return held if isinstance(held, tuple) else lasso.moments(held[:, :-1], held[:, -1])


def summed(table: DataFrame, batch: list[dict]) -> DataFrame:
    """cluster and n, mean, cross (see moments_of) of the batch's columns over all cells. table: cell_table."""
    cols = np.array(columns(batch))
    used = np.unique(cols[:, 0])
    place, ligand = np.searchsorted(used, cols[:, 0]), cols[:, 1]
    pair = ligand >= 0
    fan = max(1, math.ceil(math.sqrt(table.rdd.getNumPartitions())))
    kind = "cluster int, salt int, n long, mean binary, cross binary"

    def rows(sums: dict, salt: int) -> pd.DataFrame:
        return pd.DataFrame([(c, salt, *packed(held)) for c, held in sums.items()], columns=["cluster", "salt", "n", "mean", "cross"])

    def part(frames):
        from pyspark import TaskContext

        context = TaskContext.get()
        salt = (context.partitionId() if context else 0) % fan
        sums: dict = {}
        for frame in frames:
            for start in range(0, len(frame), ROWS):
                own = frame.iloc[start : start + ROWS]
                e = np.zeros((len(own), len(used)))
                for row, (gi, gv) in enumerate(zip(own["gi"], own["gv"])):
                    gi = np.asarray(gi, np.int64)
                    to = np.minimum(np.searchsorted(used, gi), len(used) - 1)
                    hit = used[to] == gi
                    np.add.at(e[row], to[hit], np.asarray(gv, float)[hit])
                z = e[:, place]
                if pair.any():
                    z[:, pair] *= np.array(own["rw"].tolist(), float).reshape(len(own), -1)[:, ligand[pair]]
                cluster = own["cluster"].to_numpy()
                for c in np.unique(cluster):
                    sums[int(c)] = grown(sums.get(int(c)), z[cluster == c])
        yield rows(sums, salt)

    def together(own: pd.DataFrame) -> pd.DataFrame:
        total = None
        for n, m, x in zip(own["n"], own["mean"], own["cross"]):
            total = joined(total, unpacked(n, m, x))
        return rows({int(own["cluster"].iloc[0]): total}, 0)

    once = table.mapInPandas(part, kind)
    if fan > 1:
        once = once.groupBy("cluster", "salt").applyInPandas(together, kind)
    return once.groupBy("cluster").applyInPandas(together, kind).drop("salt")


def each(sums: DataFrame, batch: list[dict], run, schema: str) -> DataFrame:
    """The frames that run(spec, cluster, n, mean, cross) gives for each target and cluster, factors that are not allowed
    there set to 0. Clusters are dealt once more where there are fewer of them than tasks at a time."""
    at = {c: k for k, c in enumerate(columns(batch))}
    own = [places(s, at) for s in batch]
    context = sums.sparkSession.sparkContext
    split = max(1, min(len(batch), context.defaultParallelism // 8))

    def go(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                n, mean, cross = moments_of(r.n, r.mean, r.cross)
                for k in range(r.turn, len(batch), split):
                    m, x = mean[own[k]], cross[np.ix_(own[k], own[k])]
                    no = batch[k]["blocked"].get(int(r.cluster))
                    if no is not None and len(no):
                        m[no], x[no, :], x[:, no] = 0.0, 0.0, 0.0
                    yield run(batch[k], int(r.cluster), n, m, x)

    turns = sums.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))
    return (turns.repartition("cluster", "turn") if split > 1 else turns).mapInPandas(go, schema)


def fitted(sums: DataFrame, batch: list[dict], **options) -> DataFrame:
    """A fit for each target of the batch and row of summed."""

    def run(s, cluster, n, mean, cross):
        got = lasso.fit_moments(n, mean, cross, s["groups"], **options)
        row = (s["target"], cluster, n, got["intercept"], s["names"], got["coef"].tolist(), got["r2"], got["mse"], got["iterations"], got["converged"])
        return pd.DataFrame([row], columns=["target", "cluster", "n_cells", "intercept", "terms", "coef", "r2", "mse", "iterations", "converged"])

    return each(sums, batch, run, FITS)


def coefficients(fits: DataFrame) -> DataFrame:
    """target, row_id, term, beta of the fits: terms that are zero in every cluster are left out, and so are targets of
    which only the intercept or nothing is left. Values that aren't finite are 0."""
    ok = lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    pairs = F.arrays_zip(F.concat(F.array(F.lit("beta0")), "terms").alias("term"), F.concat(F.array("intercept"), "coef").alias("beta"))
    long = fits.select("target", F.col("cluster").cast("string").alias("row_id"), F.explode(pairs).alias("p")).select("target", "row_id", F.col("p.term").alias("term"), ok(F.col("p.beta")).alias("beta"))
    some = long.groupBy("target", "term").agg(F.max(F.abs("beta")).alias("most")).where("most > 0").select("target", "term")
    full = some.where("term != 'beta0'").select("target").distinct()
    return long.join(some, ["target", "term"], "left_semi").join(full, "target", "left_semi")
