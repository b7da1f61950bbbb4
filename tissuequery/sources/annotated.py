"""Annotated datasets: matrices dense or sparse by row or by column, as cells and sparse expression.

A container is any mapping of paths to arrays and groups (an open HDF5 file, or nested dicts); the HDF5 reader is needed
only for `.h5ad` files. Row blocks are read by the tasks, so no task and no driver holds the whole matrix.
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The keys under which files keep coordinates, embeddings and labels, in order of preference.
SPATIAL_KEYS = ("spatial", "X_spatial", "spatial_loc")
UMAP_KEYS = ("X_umap", "umap")
TYPE_COLUMNS = ("cell_type", "cell_types", "celltype", "major_cell_type")


def opened(path: str):
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading .h5ad files needs h5py; Parquet datasets need nothing (read_dataset)") from e
    return h5py.File(path, "r")


def _group(root, *path):
    for name in path:
        if root is None or name not in root:
            return None
        root = root[name]
    return root


def layer_of(root, layer: str, strict: bool = False):
    """The named layer; X for '' or 'X' and, unless strict, for a layer that isn't there."""
    if layer not in ("", "X"):
        found = _group(root, "layers", layer)
        if found is not None:
            return found
        if strict:
            raise KeyError(f"no layer {layer}")
    found = _group(root, "X")
    if found is None:
        raise KeyError(f"no layer {layer} and no X")
    return found


def is_sparse(node) -> bool:
    return all(k in node for k in ("data", "indices", "indptr")) if hasattr(node, "keys") else False


def by_column(node) -> bool:
    kind = node.attrs.get("encoding-type", "") if hasattr(node, "attrs") else node.get("encoding-type", "")
    return str(kind).startswith("csc")


def triplets(node, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of a block of rows (of columns, where stored by column): repeated entries are added, zeros
    are left out."""
    if hasattr(node, "keys") and not is_sparse(node):
        raise TypeError("a matrix is expected, not a table")
    if is_sparse(node):
        ends = np.asarray(node["indptr"][start : stop + 1], np.int64)
        major = np.repeat(np.arange(start, start + len(ends) - 1), np.diff(ends))
        minor = np.asarray(node["indices"][ends[0] : ends[-1]], np.int64) if len(ends) else np.empty(0, np.int64)
        value = np.asarray(node["data"][ends[0] : ends[-1]], np.float64) if len(ends) else np.empty(0)
        r, c = (minor, major) if by_column(node) else (major, minor)
    else:
        block = np.asarray(node[start:stop], np.float64)
        r, c = np.nonzero(block)
        value, r = block[r, c], r + start
    out = pd.DataFrame({"r": r, "c": c, "v": value}).groupby(["r", "c"], sort=True, as_index=False)["v"].sum()
    out = out[out["v"] != 0]
    return out["r"].to_numpy(), out["c"].to_numpy(), out["v"].to_numpy()


def major_size(node) -> int:
    return len(node["indptr"]) - 1 if is_sparse(node) else node.shape[0]


def coordinates(root, keys: tuple[str, ...], n: int | None = None) -> tuple[str, np.ndarray] | None:
    """(key, first two columns) of the first key with rows (n, if given) and two columns."""
    for key in keys:
        found = _group(root, "obsm", key)
        if found is not None and len(found.shape) == 2 and found.shape[0] >= 1 and found.shape[1] >= 2 and n in (None, found.shape[0]):
            return key, np.asarray(found[:, :2], np.float64)
    return None


def spatial(root) -> tuple[str, np.ndarray]:
    found = coordinates(root, SPATIAL_KEYS)
    if found is None:
        raise KeyError("no coordinates; looked for " + ", ".join(SPATIAL_KEYS))
    return found


def type_column(columns: list[str]) -> str | None:
    return next((c for c in TYPE_COLUMNS if c in columns), next((c for c in columns if c.lower() == "cell_type"), None))


def cluster_ids(values: pd.Series, rounded: bool = False) -> np.ndarray:
    """Whole ids: null is 0; rounded halves away from zero, else truncated."""
    v = pd.to_numeric(values, errors="raise").astype(float).fillna(0.0).to_numpy()
    return (np.sign(v) * np.floor(np.abs(v) + 0.5) if rounded else np.trunc(v)).astype(np.int64)


def expression(spark: SparkSession, path: str, layer: str, genes: list[str], strict: bool = False, block: int = 4096, opener=opened) -> DataFrame:
    """cell_idx, gene, value of a file that all executors can open, read in blocks by the tasks."""
    root = opener(path)
    n = major_size(layer_of(root, layer, strict))
    starts = spark.range(0, n, block, numPartitions=max(1, min(-(-n // block), 10_000)))
    names = spark.sparkContext.broadcast(np.array(genes, object))  # a file's genes: tens of thousands at most

    def run(batches):
        node = layer_of(opener(path), layer, strict)
        for pdf in batches:
            for s in pdf["id"]:
                r, c, v = triplets(node, int(s), min(int(s) + block, n))
                yield pd.DataFrame({"cell_idx": r, "gene": names.value[c], "value": v})

    return starts.mapInPandas(run, "cell_idx long, gene string, value double")


def check_training_inputs(cells: DataFrame, genes: DataFrame, targets: DataFrame, cluster: str = "cluster") -> None:
    """Raises what keeps training from starting, each fault by name."""
    for name, df in (("cells", cells), ("genes", genes), ("targets", targets)):
        if df.isEmpty():
            raise ValueError(f"no {name}")
    if cluster not in cells.columns:
        raise ValueError(f"no column {cluster}; there are " + ", ".join(cells.columns[:25]))
    bad = cells.where(F.col(cluster).isNotNull() & F.col(cluster).try_cast("double").isNull())
    if not bad.isEmpty():
        raise ValueError(f"column {cluster} isn't numeric")


def write_dataset(folder: str, cells: DataFrame, values: DataFrame, genes: DataFrame, counts: DataFrame | None = None, maps: DataFrame | None = None, parameters: dict | None = None) -> None:
    """A dataset as Parquet tables: cells, expression without zeros, genes, and what training would recompute (neighbour
    counts, niche maps) with its parameters."""
    spark = cells.sparkSession
    cells.write.mode("overwrite").parquet(f"{folder}/cells")
    values.where("value != 0").write.mode("overwrite").parquet(f"{folder}/expression")
    genes.write.mode("overwrite").parquet(f"{folder}/genes")
    for name, df in (("counts", counts), ("maps", maps)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(json.dumps(parameters or {}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/parameters")


def read_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame | dict]:
    """The tables of write_dataset, checked: columns, coordinates, no stored zeros, only known cells and genes."""
    out: dict = {name: spark.read.parquet(f"{folder}/{name}") for name in ("cells", "expression", "genes")}
    for name, needed in (("cells", {"cell_idx", "x", "y", "cluster"}), ("expression", {"cell_idx", "gene", "value"}), ("genes", {"gene"})):
        missing = needed - set(out[name].columns)
        if missing:
            raise ValueError(f"{name} lacks {sorted(missing)}")
    if out["cells"].isEmpty() or not out["expression"].where("value = 0").isEmpty():
        raise ValueError("no cells, or zeros in the expression")
    strange = out["expression"].join(out["cells"].select("cell_idx"), "cell_idx", "left_anti").limit(1).union(out["expression"].join(F.broadcast(out["genes"].select("gene")), "gene", "left_anti").select(out["expression"].columns).limit(1))
    if not strange.isEmpty():
        raise ValueError("expression of unknown cells or genes")
    out["parameters"] = json.loads(spark.read.text(f"{folder}/parameters").first()[0])
    return out


def condition_plans(groups: DataFrame, output: str) -> DataFrame:
    """condition, n, folder: where each condition's run writes. groups: summaries.condition_groups."""
    return groups.select("condition", "n", F.concat(F.lit(str(Path(output) / "conditions") + "/"), "directory").alias("folder"))
