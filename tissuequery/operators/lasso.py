"""Sparse-group lasso by accelerated proximal gradient, one fit a target and cluster.

Minimises (1/2n) |Xw - y|^2 + sum over groups of reg_g |w_g| + l1 |w|_1; an intercept is taken out by centring. A fit
needs the centred cross products of its columns only, which add up over parts of the rows: `training` sums them where
the cells are, so that no task holds a design. fit_groups takes a design that is there already, (target, cluster) by
(target, cluster).
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def soft(w: np.ndarray, reg: float) -> np.ndarray:
    return np.sign(w) * np.maximum(0.0, np.abs(w) - reg)


def shrink(block: np.ndarray, reg: float) -> np.ndarray:
    """The block scaled towards zero by reg in norm."""
    size = float(np.sqrt((block * block).sum()))
    return block * max(0.0, 1.0 - reg / size) if size > 0 else block


def prox(w: np.ndarray, l1: float, group_regs: dict[int, float], groups: np.ndarray) -> np.ndarray:
    """L1, then each group's norm; negative groups are free of the latter."""
    out = soft(w, l1)
    for g, reg in group_regs.items():
        own = groups == g
        out[own] = shrink(out[own], reg)
    return out


def group_strengths(groups: np.ndarray, reg: float, scaling: str = "size") -> dict[int, float]:
    factor = {"size": np.sqrt, "none": lambda n: 1.0, "inverse": lambda n: 1.0 / np.sqrt(n)}[scaling]
    return {int(g): reg * float(factor((groups == g).sum())) for g in np.unique(groups) if g >= 0}


def penalty(w: np.ndarray, l1: float, group_regs: dict[int, float], groups: np.ndarray) -> float:
    return float(sum(reg * np.sqrt((w[groups == g] ** 2).sum()) for g, reg in group_regs.items()) + l1 * np.abs(w).sum())


def checked_groups(groups, width: int) -> np.ndarray:
    """A group for each feature; without any, every feature is a group of its own."""
    if groups is None or not len(groups):
        return np.arange(width)
    if len(groups) != width:
        raise ValueError(f"{len(groups)} groups for {width} features")
    return np.asarray(groups, np.int64)


def moments(x: np.ndarray, y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, centred cross products) of the columns of x and, last, y: all that a fit needs."""
    z = np.column_stack([x, y])
    mean = z.mean(0) if len(z) else np.zeros(z.shape[1])
    z = z - mean
    return len(z), mean, z.T @ z


def merged(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    """The moments of two sets of rows together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return b if not a[0] else a
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def fit_moments(n: int, mean: np.ndarray, cross: np.ndarray, groups=None, l1: float = 1e-5, group_reg: float = 1e-5, iterations: int = 500, tolerance: float = 1e-5, intercept: bool = True, scaling: str = "size", group_regs: dict[int, float] | None = None, bound: str = "singular") -> dict:
    """coef, intercept, converged, iterations, r2, mse. Restarts the momentum where it points uphill and doubles the
    curvature until the quadratic bound holds. A step costs the square of the number of features, whatever n is.
    group_regs: penalties as they are, instead of group_reg scaled by size. bound: the first curvature, 1.5 times the
    largest singular value's square ("singular") or the sum of squares ("frobenius")."""
    p = len(mean) - 1
    groups = checked_groups(groups, p)
    full = cross if intercept else cross + n * np.outer(mean, mean)
    regs = group_strengths(groups, group_reg, scaling) if group_regs is None else group_regs
    size = max(n, 1)
    gram, xy, yy = full[:p, :p] / size, full[:p, p] / size, float(full[p, p]) / size
    top = 0.0 if not p else float(np.trace(gram)) if bound == "frobenius" else 1.5 * float(np.linalg.eigvalsh(gram)[-1])
    lip = max(1e-12, top)

    def smooth(w):
        return 0.5 * float(w @ (gram @ w)) - float(xy @ w) + 0.5 * yy

    w = z = np.zeros(p)
    t, done, k = 1.0, p == 0, 0
    for k in range(1, iterations + 1):
        if done:
            break
        gradient, at = gram @ z - xy, smooth(z)
        while True:
            new = prox(z - gradient / lip, l1 / lip, {g: r / lip for g, r in regs.items()}, groups)
            step = new - z
            if smooth(new) <= at + gradient @ step + lip / 2 * (step @ step) + 1e-15 * max(1.0, yy):
                break
            lip *= 2
        if (z - new) @ (new - w) > 0:
            t = 1.0
        nt = 0.5 + 0.5 * np.sqrt(1 + 4 * t * t)
        z = new + (t - 1) / nt * (new - w)
        done = np.linalg.norm(new - w) <= tolerance * max(1e-12, np.linalg.norm(new))
        w, t = new, nt
    mse = max(0.0, 2 * smooth(w))
    var = float(cross[p, p]) / size
    return {"coef": w, "intercept": float(mean[p] - mean[:p] @ w) if intercept else 0.0, "converged": bool(done), "iterations": k, "r2": 1 - mse / var if var > 0 else 0.0, "mse": mse if n else 0.0}


def fit(x: np.ndarray, y: np.ndarray, groups=None, *args, **options) -> dict:
    """The fit of arrays in memory; fit_moments names the options."""
    return fit_moments(*moments(x, y), groups, *args, **options)


def fit_groups(design: DataFrame, **options) -> DataFrame:
    """design: target, cluster, y, x (array), groups (array, the same in every row of a fit). One row a fit: target,
    cluster, n_cells, intercept, coef, r2, mse, iterations, converged."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        x = np.array(own["x"].tolist(), np.float64).reshape(len(own), -1)
        got = fit(x, own["y"].to_numpy(np.float64), np.asarray(own["groups"].iloc[0], np.int64), **options)
        return pd.DataFrame([{"target": own["target"].iloc[0], "cluster": own["cluster"].iloc[0], "n_cells": len(own), "intercept": got["intercept"], "coef": got["coef"].tolist(), "r2": got["r2"], "mse": got["mse"], "iterations": got["iterations"], "converged": got["converged"]}])

    return design.groupBy("target", "cluster").applyInPandas(run, "target string, cluster int, n_cells long, intercept double, coef array<double>, r2 double, mse double, iterations int, converged boolean")


def gated(fits: DataFrame, least_r2: float) -> DataFrame:
    """Fits of low or undefined R2 become zero."""
    bad = F.isnan("r2") | (F.col("r2") < least_r2)
    return fits.withColumn("coef", F.when(bad, F.transform("coef", lambda c: F.lit(0.0))).otherwise(F.col("coef"))).withColumn("intercept", F.when(bad, 0.0).otherwise(F.col("intercept"))).withColumn("r2", F.when(bad, 0.0).otherwise(F.col("r2")))


def predicted(design: DataFrame, fits: DataFrame) -> DataFrame:
    """target, cluster, cell_idx, y, y_hat; a cluster without a fit predicts 0."""
    joined = design.join(fits.select("target", "cluster", "intercept", "coef"), ["target", "cluster"], "left")
    dot = F.aggregate(F.zip_with("x", "coef", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return joined.select("target", "cluster", "cell_idx", "y", F.coalesce(F.col("intercept") + dot, F.lit(0.0)).alias("y_hat"))


def quality(predictions: DataFrame) -> DataFrame:
    """target, cluster, n, mse, r2 (0 without variance)."""
    out = predictions.groupBy("target", "cluster").agg(F.count("*").alias("n"), F.sum((F.col("y") - F.col("y_hat")) * (F.col("y") - F.col("y_hat"))).alias("res"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"))
    tot = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return out.select("target", "cluster", "n", (F.col("res") / F.col("n")).alias("mse"), F.when(tot > 1e-15, 1 - F.col("res") / tot).otherwise(0.0).alias("r2"))


def chosen_rows(n: int, scheme: str | float | int | None, rng: np.random.Generator) -> np.ndarray:
    """Sorted row numbers: all (None), a share (float), a count (int) or the root of n ('sqrt')."""
    if scheme is None:
        return np.arange(n)
    many = int(np.sqrt(n)) if scheme == "sqrt" else int(n * scheme) if isinstance(scheme, float) else int(scheme)
    return np.sort(rng.choice(n, size=max(1, min(many, n)), replace=False)) if n else np.arange(0)


def largest_singular_value(x: np.ndarray, scheme=None, seed: int = 0, most: int = 20, tolerance: float = 5e-3) -> float:
    """By power iteration from a seeded start; with a scheme on some rows, scaled up to all."""
    rng = np.random.default_rng(seed)
    rows = chosen_rows(len(x), scheme, rng)
    own, size = x[rows], 0.0
    if not own.size:
        return 0.0
    v = rng.normal(size=x.shape[1])
    for _ in range(most):
        v = own.T @ (own @ (v / max(float(np.linalg.norm(v)), 1e-300)))
        now = float(np.sqrt(np.linalg.norm(v)))
        if abs(now - size) <= tolerance * now:
            size = now
            break
        size = now
    return size * float(np.sqrt(len(x) / len(rows)))


def active(coef: np.ndarray) -> np.ndarray:
    """Which features a fit uses: coefficients that aren't negligible beside the mean size."""
    return np.abs(coef) > 1e-10 * np.abs(coef).mean() if len(coef) else np.zeros(0, bool)


def active_groups(coef: np.ndarray, groups: np.ndarray) -> set[int]:
    return {int(g) for g in np.unique(groups[active(coef)])}


def transformed(x: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """The columns of the features in use."""
    return x[:, active(coef)]


def predict(x: np.ndarray, fitted: dict) -> np.ndarray:
    if x.shape[1] != len(fitted["coef"]):
        raise ValueError(f"{x.shape[1]} columns for {len(fitted['coef'])} coefficients")
    return x @ fitted["coef"] + fitted["intercept"]


def fit_clusters(x: np.ndarray, y: np.ndarray, clusters: np.ndarray, groups: np.ndarray, **options) -> dict[int, dict]:
    """A fit for each cluster of arrays in memory; for tables use fit_groups."""
    return {int(c): fit(x[clusters == c], y[clusters == c], groups, **options) for c in np.unique(clusters)}


def predict_clusters(x: np.ndarray, clusters: np.ndarray, fits: dict[int, dict]) -> np.ndarray:
    out = np.zeros(len(x))
    for c in np.unique(clusters):
        if int(c) not in fits:
            raise KeyError(f"no fit of cluster {c}")
        out[clusters == c] = predict(x[clusters == c], fits[int(c)])
    return out
