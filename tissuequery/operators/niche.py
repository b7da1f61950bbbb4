"""Neural refinement of coefficients: a small convolutional network over a cell's niche map scales the lasso's fit.

A cell's coefficients are anchors * activation(head(pool(conv(map)) + mlp(neighbour counts))), where the anchors are the
lasso's intercept and coefficients of its target and cluster. Training is one group of applyInPandas a target and
cluster; prediction takes blocks of cells, so its memory is bounded however large a cluster is. Arrays are float64 and
channel-first; weights are exchanged as NPZ.
"""

from __future__ import annotations

import io
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lasso

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The network's shape, its slope below zero, and the activations' codes.
CHANNELS = (1, 16, 32, 64)
HIDDEN = (16, 32, 64)
SLOPE = 0.1
ACTIVATIONS = {"identity": 0, "sigmoid": 1, "tanh": 2, "sigmoid_x2": 3}
LEAST_SIDE = 8  # three halvings leave one square

MOMENTUM, EPSILON = 0.1, 1e-5


def initial(anchors: np.ndarray, n_clusters: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Uniform weights within one over the root of the fan-in; the anchors are constants."""
    rng = np.random.default_rng(seed)

    def drawn(shape, fan):
        return rng.uniform(-1, 1, shape) / np.sqrt(max(fan, 1))

    w: dict[str, np.ndarray] = {"anchors": np.asarray(anchors, np.float64)}
    for k, (a, b) in enumerate(zip(CHANNELS, CHANNELS[1:]), 1):
        w |= {f"conv{k}_weight": drawn((b, a, 3, 3), 9 * a), f"conv{k}_bias": drawn(b, 9 * a), f"bn{k}_gamma": np.ones(b), f"bn{k}_beta": np.zeros(b), f"bn{k}_running_mean": np.zeros(b), f"bn{k}_running_var": np.ones(b)}
    for k, (a, b) in enumerate(zip((n_clusters, *HIDDEN), HIDDEN), 1):
        w |= {f"spatial_l{k}_weight": drawn((b, a), a), f"spatial_l{k}_bias": drawn(b, a)}
    for k, (a, b) in enumerate(((64, 64), (64, len(anchors))), 1):
        w |= {f"head_l{k}_weight": drawn((b, a), a), f"head_l{k}_bias": drawn(b, a)}
    return w


def _leaky(x):
    return np.where(x > 0, x, SLOPE * x)


def _windows(x):
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1))), (3, 3), axis=(2, 3))


def _convolved(windows, weight):
    return np.tensordot(windows, weight, axes=([1, 4, 5], [1, 2, 3])).transpose(0, 3, 1, 2)


def _pooled(x):
    """Maxima of 2 x 2 squares (an odd last row or column is left out) and where they were."""
    n, c, h, w = x.shape
    squares = x[:, :, : h // 2 * 2, : w // 2 * 2].reshape(n, c, h // 2, 2, w // 2, 2).transpose(0, 1, 2, 4, 3, 5).reshape(n, c, h // 2, w // 2, 4)
    at = squares.argmax(-1)
    return np.take_along_axis(squares, at[..., None], -1)[..., 0], at


def _unpooled(grad, at, shape):
    n, c, h, w = shape
    squares = np.zeros((*grad.shape, 4))
    np.put_along_axis(squares, at[..., None], grad[..., None], -1)
    out = np.zeros(shape)
    out[:, :, : h // 2 * 2, : w // 2 * 2] = squares.reshape(n, c, h // 2, w // 2, 2, 2).transpose(0, 1, 2, 4, 3, 5).reshape(n, c, h // 2 * 2, w // 2 * 2)
    return out


def activated(x: np.ndarray, activation: str) -> np.ndarray:
    if activation == "identity":
        return x
    if activation == "tanh":
        return np.tanh(x)
    s = 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))
    return 2.0 * s if activation == "sigmoid_x2" else s


def _slope(value, activation):
    """The activation's derivative by its value."""
    if activation == "identity":
        return np.ones_like(value)
    if activation == "tanh":
        return 1.0 - value * value
    return value * (1.0 - value / 2.0) if activation == "sigmoid_x2" else value * (1.0 - value)


def forward(w: dict, maps: np.ndarray, counts: np.ndarray, activation: str = "sigmoid", training: bool = False):
    """(coefficients of every cell, what the backward pass needs). maps: cells x side x side; counts: cells x clusters."""
    x, kept = maps[:, None], {}
    for k in (1, 2, 3):
        windows = _windows(x)
        z = _convolved(windows, w[f"conv{k}_weight"]) + w[f"conv{k}_bias"][:, None, None]
        if training:
            mean, var = z.mean((0, 2, 3)), z.var((0, 2, 3))
            kept[f"moments{k}"] = mean, var
        else:
            mean, var = w[f"bn{k}_running_mean"], w[f"bn{k}_running_var"]
        scale = 1.0 / np.sqrt(var + EPSILON)
        unit = (z - mean[:, None, None]) * scale[:, None, None]
        normed = unit * w[f"bn{k}_gamma"][:, None, None] + w[f"bn{k}_beta"][:, None, None]
        pooled, at = _pooled(_leaky(normed))
        kept[k] = windows, unit, scale, normed, at
        x = pooled
    s, layers = counts, []
    for k in (1, 2, 3):
        z = s @ w[f"spatial_l{k}_weight"].T + w[f"spatial_l{k}_bias"]
        layers.append((s, z))
        s = _leaky(z) if k < 3 else z
    joint = x.mean((2, 3)) + s
    hidden = joint @ w["head_l1_weight"].T + w["head_l1_bias"]
    value = activated(_leaky(hidden) @ w["head_l2_weight"].T + w["head_l2_bias"], activation)
    kept |= {"layers": layers, "pool_shape": x.shape, "joint": joint, "hidden": hidden, "value": value}
    return value * w["anchors"], kept


def backward(w: dict, kept: dict, grad: np.ndarray, activation: str) -> dict[str, np.ndarray]:
    """Gradients of all trained weights from those of the coefficients (batch statistics are differentiated too)."""
    g: dict[str, np.ndarray] = {}
    d = grad * w["anchors"] * _slope(kept["value"], activation)
    hidden = kept["hidden"]
    g["head_l2_weight"], g["head_l2_bias"] = d.T @ _leaky(hidden), d.sum(0)
    d = d @ w["head_l2_weight"] * np.where(hidden > 0, 1.0, SLOPE)
    g["head_l1_weight"], g["head_l1_bias"] = d.T @ kept["joint"], d.sum(0)
    joint = s = d @ w["head_l1_weight"]
    for k in (3, 2, 1):
        own, z = kept["layers"][k - 1]
        s = s if k == 3 else s * np.where(z > 0, 1.0, SLOPE)
        g[f"spatial_l{k}_weight"], g[f"spatial_l{k}_bias"] = s.T @ own, s.sum(0)
        s = s @ w[f"spatial_l{k}_weight"]
    _, _, h, v = kept["pool_shape"]
    x = np.broadcast_to(joint[:, :, None, None] / (h * v), kept["pool_shape"])
    for k in (3, 2, 1):
        windows, unit, scale, normed, at = kept[k]
        x = _unpooled(x, at, normed.shape) * np.where(normed > 0, 1.0, SLOPE)
        g[f"bn{k}_gamma"], g[f"bn{k}_beta"] = (x * unit).sum((0, 2, 3)), x.sum((0, 2, 3))
        x = x * w[f"bn{k}_gamma"][:, None, None]
        x = (x - x.mean((0, 2, 3))[:, None, None] - unit * (x * unit).mean((0, 2, 3))[:, None, None]) * scale[:, None, None]
        g[f"conv{k}_weight"], g[f"conv{k}_bias"] = np.tensordot(x, windows, axes=([0, 2, 3], [0, 2, 3])), x.sum((0, 2, 3))
        if k > 1:
            x = _convolved(_windows(x), w[f"conv{k}_weight"][:, :, ::-1, ::-1].transpose(1, 0, 2, 3))
    return g


def train(x, y, maps, counts, anchors, epochs: int, rate: float = 2e-4, activation: str = "sigmoid", betas=(0.9, 0.999), epsilon: float = 1e-5, decay: float = 0.0, clip: float | None = None, batch: int = 2048, seed: int = 0):
    """(weights, mean squared error of every epoch) by Adam. Groups of up to `batch` cells take one step an epoch; larger
    ones go through shuffled blocks of that size, which bounds the memory."""
    if maps.shape[1] < LEAST_SIDE or maps.shape[2] < LEAST_SIDE:
        raise ValueError(f"maps need at least {LEAST_SIDE} squares a side")
    x, y, maps, counts = (np.nan_to_num(np.asarray(v, np.float64), nan=0.0, posinf=0.0, neginf=0.0) for v in (x, y, maps, counts))
    w, rng = initial(anchors, counts.shape[1], seed), np.random.default_rng(seed)
    first, second, errors, step = {}, {}, [], 0
    for _ in range(epochs):
        order, total = rng.permutation(len(y)), 0.0
        for own in np.array_split(order, max(1, -(-len(y) // batch))):
            got, kept = forward(w, maps[own], counts[own], activation, training=True)
            miss = got[:, 0] + (got[:, 1:] * x[own]).sum(1) - y[own]
            total += float(miss @ miss)
            g = backward(w, kept, (2.0 / len(own)) * miss[:, None] * np.column_stack([np.ones(len(own)), x[own]]), activation)
            if clip is not None:
                size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                g = {k: v * min(1.0, clip / max(size, 1e-12)) for k, v in g.items()}
            step += 1
            for k, v in g.items():
                v = v + decay * w[k]
                first[k] = betas[0] * first.get(k, 0.0) + (1 - betas[0]) * v
                second[k] = betas[1] * second.get(k, 0.0) + (1 - betas[1]) * v * v
                w[k] = w[k] - rate * (first[k] / (1 - betas[0] ** step)) / (np.sqrt(second[k] / (1 - betas[1] ** step)) + epsilon)
            for k in (1, 2, 3):
                mean, var = kept[f"moments{k}"]
                w[f"bn{k}_running_mean"] = (1 - MOMENTUM) * w[f"bn{k}_running_mean"] + MOMENTUM * mean
                w[f"bn{k}_running_var"] = (1 - MOMENTUM) * w[f"bn{k}_running_var"] + MOMENTUM * var
        errors.append(total / max(len(y), 1))
    return w, errors


def packed_models(models: dict[int, dict], side: int, activation: str = "sigmoid", skip: set[int] = frozenset()) -> bytes | None:
    """An NPZ of a gene's models by cluster; None if none is left."""
    own = {c: w for c, w in sorted(models.items()) if c not in skip}
    if not own:
        return None
    one = next(iter(own.values()))
    arrays = {"cluster_ids": np.array(list(own), np.uint32), "meta_spatial_dim": np.array([side], np.uint32), "meta_n_clusters": np.array([one["spatial_l1_weight"].shape[1]], np.uint32), "meta_n_modulators": np.array([len(one["anchors"]) - 1], np.uint32), "meta_cnn_output_activation": np.array([ACTIVATIONS[activation]], np.uint32)}
    for c, w in own.items():
        arrays |= {f"c{c:04d}_{k}": v.astype(np.float32) for k, v in w.items()}
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def unpacked_models(content: bytes) -> tuple[dict[int, dict], int, str]:
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        models = {int(c): {k[6:]: z[k].astype(np.float64) for k in z.files if k.startswith(f"c{int(c):04d}_")} for c in z["cluster_ids"]}
        tag = int(z["meta_cnn_output_activation"][0])
        return models, int(z["meta_spatial_dim"][0]), next((n for n, t in ACTIVATIONS.items() if t == tag), "sigmoid")


def _arrays(own: pd.DataFrame):
    maps = np.array(own["map"].tolist(), np.float64)
    side = int(round(np.sqrt(maps.shape[1])))
    return np.array(own["x"].tolist(), np.float64).reshape(len(own), -1), maps.reshape(len(own), side, side), np.array(own["counts"].tolist(), np.float64)


def fit_groups(design: DataFrame, epochs: int, rate: float = 2e-4, activation: str = "sigmoid", least_r2: float = 0.1, **lasso_options) -> DataFrame:
    """One row a fit: target, cluster, n_cells, r2, mse, epoch_mse, model (NPZ; null where R2 is undefined or too small).
    design: target, cluster, cell_idx, y, x, groups, map (side * side), counts; any row order gives the same model."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("cell_idx", kind="stable")
        x, maps, counts = _arrays(own)
        y = own["y"].to_numpy(np.float64)
        got = lasso.fit(x, y, np.asarray(own["groups"].iloc[0], np.int64), **lasso_options)
        model, errors, cluster = None, [], int(own["cluster"].iloc[0])
        if np.isfinite(got["r2"]) and got["r2"] >= least_r2:
            w, errors = train(x, y, maps, counts, np.concatenate([[got["intercept"]], got["coef"]]), epochs, rate, activation)
            model = packed_models({cluster: w}, maps.shape[1], activation)
        return pd.DataFrame([{"target": own["target"].iloc[0], "cluster": cluster, "n_cells": len(own), "r2": got["r2"], "mse": got["mse"], "epoch_mse": errors, "model": model}])

    return design.groupBy("target", "cluster").applyInPandas(run, "target string, cluster int, n_cells long, r2 double, mse double, epoch_mse array<double>, model binary")


def predicted_betas(design: DataFrame, fits: DataFrame, block: int = 4096) -> DataFrame:
    """target, cell_idx, beta (intercept first; 0 where not finite or without a model). Blocks of cell ids meet their
    group's model, so no task holds a whole cluster."""
    blocks = design.select("target", "cluster", "cell_idx", "x", "map", "counts", F.floor(F.col("cell_idx") / block).alias("block"))
    models = blocks.select("target", "cluster", "block").distinct().join(fits.select("target", "cluster", "model"), ["target", "cluster"], "left").toDF("t", "c", "b", "model")  # new names: both sides come from `design`

    def run(own: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"target": [], "cell_idx": [], "beta": []})
        x, maps, counts = _arrays(own)
        content = next((m for m in fitted["model"] if m is not None), None)
        if content is None:
            beta = np.zeros((len(own), x.shape[1] + 1))
        else:
            found, _, activation = unpacked_models(content)
            beta = np.nan_to_num(forward(next(iter(found.values())), maps, counts, activation)[0], nan=0.0, posinf=0.0, neginf=0.0)
        return pd.DataFrame({"target": own["target"].to_numpy(), "cell_idx": own["cell_idx"].to_numpy(), "beta": list(beta)})

    return blocks.groupBy("target", "cluster", "block").cogroup(models.groupBy("t", "c", "b")).applyInPandas(run, "target string, cell_idx long, beta array<double>")


def niche_maps(maps: DataFrame) -> DataFrame:
    """cell_idx, map: the squares of summaries.spatial_map in row order."""
    item = F.struct("i", "j", "value")
    return maps.groupBy("cell_idx").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["value"]).alias("map"))


def niche_counts(neighbor_counts: DataFrame, n_clusters: int) -> DataFrame:
    """cell_idx, counts: neighbours by cluster 0 .. n_clusters - 1. neighbor_counts: cell_idx, cluster, n."""
    by = neighbor_counts.groupBy("cell_idx").agg(F.map_from_entries(F.collect_list(F.struct(F.col("cluster").cast("int"), F.col("n").cast("double")))).alias("m"))
    return by.select("cell_idx", F.transform(F.sequence(F.lit(0), F.lit(n_clusters - 1)), lambda c: F.coalesce(F.element_at("m", c), F.lit(0.0))).alias("counts"))
