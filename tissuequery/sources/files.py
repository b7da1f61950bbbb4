"""Readers and writers of interchange files. Files are read by Spark (binaryFile, text), so any store that Spark opens
will do; a file that can't be read becomes a row with its error instead of failing the job."""

from __future__ import annotations

import hashlib
import io
import json
import re
import sys
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.feather as feather
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codec import gene_of_file, term_kind, term_parts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LABEL_COLUMNS = ("Cluster", "CellID", "cell_id", "index", "obs_names")  # fixed values: names of the label column


def label_column(names: list[str]) -> str | None:
    return next((n for n in names if n in LABEL_COLUMNS or n.startswith("__index")), None)


def read_coefficients(spark: SparkSession, folder: str, pattern: str = "*_betadata.feather") -> tuple[DataFrame, DataFrame]:
    """(betas, errors) of all coefficient files: target, row_kind, row_id, term, term_type, a, b, beta; path, error."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    t = feather.read_table(io.BytesIO(content)).to_pandas()
                    label = label_column(list(t.columns))
                    if label is None:
                        raise ValueError("no label column")
                    if t[label].isna().any():
                        raise ValueError("a row without a label")
                    own = [c for c in t.columns if c != label and pd.api.types.is_numeric_dtype(t[c])]
                    if any(c.startswith("beta") for c in own):
                        own = [c for c in own if c.startswith("beta")]
                    long = t.melt(id_vars=[label], value_vars=own, var_name="term", value_name="beta")
                    yield pd.DataFrame({"path": path, "row_kind": "cluster" if label == "Cluster" else "cell", "row_id": long[label].astype(str), "term": long["term"].astype(str), "beta": long["beta"].astype(float).fillna(0.0), "error": None})
                except Exception as e:  # noqa: BLE001  a bad file is reported, not fatal
                    yield pd.DataFrame({"path": [path], "row_kind": [None], "row_id": [None], "term": [None], "beta": [None], "error": [str(e)]})

    got = raw.mapInPandas(run, "path string, row_kind string, row_id string, term string, beta double, error string")
    a, b = term_parts(F.col("term"))
    kind = term_kind(F.col("term"))
    betas = got.where("error IS NULL").select(gene_of_file(F.col("path")).alias("target"), "row_kind", "row_id", "term", kind.alias("term_type"), F.when(kind != "intercept", a).alias("a"), b.alias("b"), "beta")
    return betas, got.where("error IS NOT NULL").select("path", "error")


def coefficient_files(betas: DataFrame, id_column: str = "Cluster") -> DataFrame:
    """target, name, content: a Feather file for each target, ready for any store. betas: target, row_id, term, beta."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        wide = own.pivot_table(index="row_id", columns="term", values="beta", aggfunc="first", fill_value=0.0)
        wide = wide[sorted(wide.columns, key=lambda c: (c != "beta0", c))].reset_index().rename(columns={"row_id": id_column})
        out = io.BytesIO()
        feather.write_feather(pa.Table.from_pandas(wide, preserve_index=False), out, compression="lz4")
        target = own["target"].iloc[0]
        return pd.DataFrame({"target": [target], "name": [f"{target}_betadata.feather"], "content": [out.getvalue()]})

    return betas.select("target", "row_id", "term", "beta").groupBy("target").applyInPandas(run, "target string, name string, content binary")


def trained_genes(spark: SparkSession, folder: str, pattern: str = "*_betadata.feather") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return files.select(gene_of_file(F.col("path")).alias("gene")).where("gene != ''").orderBy("gene")


def read_priors(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """source, target, cell_type, prior_order: trimmed, known genes only, the first of equal rows. rows: these columns
    and an order column."""
    missing = {"source", "target", "cell_type"} - set(rows.columns)
    if missing:
        raise ValueError(f"priors need the columns {sorted(missing)}")
    t = rows.select(*(F.trim(c).alias(c) for c in ("source", "target", "cell_type")), "prior_order").where("source != '' AND target != '' AND cell_type != ''")
    g = F.broadcast(genes.select("gene"))
    t = t.join(g.withColumnRenamed("gene", "source"), "source", "left_semi").join(g.withColumnRenamed("gene", "target"), "target", "left_semi")
    by = Window.partitionBy("target", "cell_type", "source").orderBy("prior_order")
    return t.withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")


def infer_species(genes: DataFrame) -> str:
    """mouse if more names have a capital first and none after than have capitals only; over all genes; else human."""
    mouse = F.col("gene").rlike(r"^\p{Lu}\P{Lu}+$")
    human = F.col("gene").rlike(r"\p{Lu}") & ~F.col("gene").rlike(r"[\p{L}&&[^\p{Lu}]]")
    row = genes.agg(F.sum(mouse.cast("int")), F.sum(human.cast("int"))).first()
    return "mouse" if (row[0] or 0) > (row[1] or 0) else "human"


# The log format's first line (any producer's name before `_training_log`), headers and columns.
LOG_FIRST = r"^format\t\S*training_log\tv1$"
LOG_PRODUCER = "tissuequery_training_log"
SUMMARY = ("cluster_id", "n_cells", "n_modulators", "lasso_r2", "lasso_train_mse", "lasso_fista_iters", "lasso_converged", "cnn_epochs_ran", "cnn_mse_first", "cnn_mse_last")
LOG_ROWS = "gene string, seed_only boolean, epochs int, learning_rate double, gate map<string,string>, cluster int, n_cells long, n_modulators long, r2 double, mse double, iterations int, converged boolean, epochs_ran int, mse_first double, mse_last double"


def _log_value(v) -> str:
    return "NA" if v is None else str(v).lower() if isinstance(v, bool) else f"{v:.6f}" if isinstance(v, float) else str(v)


def write_training_log(gene: str, epochs: int, summaries: list[dict], epoch_mse: dict[int, list[float]] | None = None, gate: dict | None = None, head: dict | None = None, producer: str = LOG_PRODUCER) -> str:
    """A log's text: header, the gate's block if there is one, a row a cluster, a row an epoch. summaries: cluster,
    n_cells, n_modulators, lasso_r2, lasso_mse, iterations, converged; gate: names without their prefix."""
    losses = epoch_mse or {}
    header = {"gene": gene, "seed_only": not losses, "per_cell_cnn_export": False, "cnn_epochs_config": epochs, "learning_rate": 0, "lasso_n_iter_max": 500, "lasso_tol": 1e-5} | (head or {})
    lines = [f"format\t{producer}\tv1"] + [f"{k}\t{str(v).lower() if isinstance(v, bool) else v}" for k, v in header.items()] + [""]
    if gate:
        lines += ["# hybrid_cnn_gate"] + [f"gate_{k}\t{_log_value(v)}".replace("\n", " ") for k, v in gate.items()] + [""]
    lines += ["# summary: " + ", ".join(SUMMARY), "\t".join(SUMMARY)]
    for s in summaries:
        own = losses.get(s["cluster"], [])
        cells = [s["cluster"], s["n_cells"], s["n_modulators"], float(s["lasso_r2"]), float(s["lasso_mse"]), s["iterations"], bool(s["converged"]), len(own), float(own[0]) if own else None, float(own[-1]) if own else None]
        lines.append("\t".join(map(_log_value, cells)))
    lines += ["", "# cnn_mse_by_epoch: cluster_id, epoch, train_mse", "cluster_id\tepoch\ttrain_mse"]
    lines += [f"{c}\t{k}\t{m:.6f}" for c, own in losses.items() for k, m in enumerate(own)]
    return "\n".join(lines) + "\n"


def training_logs(fits: DataFrame, iterations: int, tolerance: float) -> DataFrame:
    """target, name, content: a log's text for each target of fits."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("cluster")
        rows = [{"cluster": int(r.cluster), "n_cells": int(r.n_cells), "n_modulators": len(r.coef), "lasso_r2": r.r2, "lasso_mse": r.mse, "iterations": int(r.iterations), "converged": bool(r.converged)} for r in own.itertuples()]
        target = own["target"].iloc[0]
        return pd.DataFrame({"target": [target], "name": [f"{target}.log"], "content": [write_training_log(target, 0, rows, head={"lasso_n_iter_max": iterations, "lasso_tol": tolerance})]})

    return fits.groupBy("target").applyInPandas(run, "target string, name string, content string")


def _parsed_log(text: str) -> list[tuple]:
    """The rows of a log; none if it is another file or has no clusters."""
    lines = [x.rstrip() for x in text.splitlines()]
    if not lines or not re.match(LOG_FIRST, lines[0].strip()):
        return []
    block, head, gate, rows = "", {}, {}, []
    for line in lines[1:]:
        cells = line.split("\t")
        if line.startswith("#"):
            block = line
        elif block.startswith("# summary"):
            if len(cells) >= len(SUMMARY) and cells[0].isdigit():
                rows.append(cells)
        elif len(cells) > 1:
            (gate if block else head)[cells[0]] = line.split("\t", 1)[1]
    gate = {k: v for k, v in gate.items() if k.startswith("gate_")} or None

    def number(v, kind=float):
        return None if v in ("NA", "", None) else kind(v)

    first = (head.get("gene"), head.get("seed_only") == "true", number(head.get("cnn_epochs_config"), int), number(head.get("learning_rate")), gate)
    return [(*first, int(c[0]), int(c[1]), int(c[2]), number(c[3]), number(c[4]), int(c[5]), c[6] == "true", int(c[7]), number(c[8]), number(c[9])) for c in rows]


def read_training_logs(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each cluster of each log (LOG_ROWS); files that are no logs or can't be read are skipped."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.log")
    names = [c.split()[0] for c in LOG_ROWS.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                try:
                    rows += _parsed_log(text)
                except ValueError:  # a number that is none
                    continue
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return raw.mapInPandas(run, LOG_ROWS).orderBy(F.lower("gene"), "cluster")


def finished_genes(spark: SparkSession, folder: str) -> DataFrame:
    """gene, status: done with a coefficient file, orphan with a mark (an empty file, which Spark's own readers pass
    over, so the store is asked for names). A folder that isn't there holds none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
    found = [(n.removesuffix(end), status) for n in names for end, status in (("_betadata.feather", "done"), (".orphan", "orphan")) if n.endswith(end) and n != end]
    return spark.createDataFrame(found, "gene string, status string").groupBy("gene").agg(F.min("status").alias("status"))


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A whole file on any store that Spark knows: written beside, then renamed."""
    java = spark._jvm
    at, beside = java.org.apache.hadoop.fs.Path(path), java.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(beside, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    if not store.rename(beside, at):
        store.delete(at, False)
        if not store.rename(beside, at):
            raise OSError(f"can't write {path}")


def request_key(genes: list[str], value: float, rounds: int, scope: dict) -> str:
    """A directory name for a perturbation request; the scope is part of it."""
    text = json.dumps({"genes": sorted(genes), "value": value, "rounds": rounds, "scope": {k: sorted(v) for k, v in sorted(scope.items())}}, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def packed(values, kind: str) -> bytes:
    """Little-endian bytes for the wire: f4, u4 (too large: the largest) or u2 codes."""
    x = np.asarray(values)
    if kind == "u4":
        x = np.minimum(x, 2**32 - 1)
    return x.astype("<" + kind).tobytes()


def interleaved(x, y) -> bytes:
    return np.column_stack([x, y]).astype("<f4").tobytes()
