"""What a run leaves behind: its summary page, perturbation tables and progress."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import gene_of_file
from ..operators.summaries import training_rollup
from ..sources.files import request_key
from .session import Session

RECENT = 64  # gene times that the mean is taken over
SHOWN_GENES = 100_000


def all_rollups(runs: dict[str, DataFrame]) -> DataFrame:
    """Roll-ups of a run ('') and of its conditions, whose genes are named condition::gene."""
    parts = [training_rollup(s).withColumn("gene", F.concat(F.lit(name + "::" if name else ""), "gene")) for name, s in sorted(runs.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("gene")


def sorted_rollups(rollups: DataFrame, text: str = "", column: str = "gene", descending: bool = False) -> DataFrame:
    """Rows whose gene holds the text in any case, sorted by a column."""
    order = F.desc(column) if descending else F.asc(column)
    return rollups.where(F.lower("gene").contains(text.strip().lower())).orderBy(order, "gene")


def extremes(rollups: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The k genes of largest and of least mean R2."""
    return rollups.orderBy(F.desc("mean_r2"), "gene").limit(k), rollups.orderBy("mean_r2", "gene").limit(k)


def bar_chart(interactions: DataFrame, kind: str, k: int) -> DataFrame:
    """The 5 to 40 largest interactions of a kind by size."""
    return interactions.where(F.col("term_type") == kind).orderBy(F.desc(F.abs("beta")), "target", "a", "b").limit(max(5, min(k, 40)))


def read_manifest(path: str, settings: dict) -> dict:
    """Settings with an optional JSON manifest over them, section by section."""
    try:
        found = json.loads(Path(path).read_text())
    except FileNotFoundError:
        return settings
    return {k: {**settings.get(k, {}), **v} if isinstance(v, dict) else v for k, v in {**settings, **found}.items()}


def summary_page(session: Session, rollups: DataFrame, settings: dict, defaults: dict, title: str = "Run summary") -> str:
    """One HTML page: the dataset's size, settings that differ from the defaults, and the genes' metrics as JSON. A page
    holds a row a gene, at most 100,000."""
    if rollups.count() > SHOWN_GENES:
        raise ValueError(f"more than {SHOWN_GENES} genes; write the roll-ups as a table")
    meta = session.meta()
    differing = {f"{s}.{k}": v for s, own in settings.items() for k, v in own.items() if defaults.get(s, {}).get(k) != v}

    def table(rows: dict) -> str:
        return "<table>" + "".join(f"<tr><th>{html.escape(str(k))}</th><td>{html.escape(str(v))}</td></tr>" for k, v in rows.items()) + "</table>"

    data = json.dumps([r.asDict() for r in rollups.orderBy("gene").collect()], sort_keys=True).replace("<", "\\u003c")
    return f'<!doctype html>\n<meta charset="utf-8"><title>{html.escape(title)}</title>\n<h1>{html.escape(title)}</h1>\n{table(meta)}\n<h2>Settings</h2>\n{table(differing)}\n<script type="application/json" id="genes">{data}</script>\n'


def write_perturbations(session: Session, genes: dict[str, float], output: str, rounds: int = 4, scope: dict | None = None) -> DataFrame:
    """A table of simulated expression (cell_id, gene, simulated) for each gene, in a folder named by the request with
    its scope; a row a gene: gene, folder, mean and largest absolute change."""
    spark, done = session.cells.sparkSession, []
    for gene, value in genes.items():
        folder = f"{output}/{request_key([gene], value, rounds, scope or {})}/{gene}"
        change = session.perturbed({gene: value}, rounds, scope)
        named = change.join(session.cells.select("cell_idx", "cell_id"), "cell_idx").select("cell_idx", "cell_id", "gene", "delta", "simulated")
        named.write.mode("overwrite").parquet(folder)
        size = F.abs("delta")
        done.append((gene, folder, *spark.read.parquet(folder).agg(F.avg(size), F.max(size)).first()))
    return spark.createDataFrame(done, "gene string, folder string, mean_abs double, max_abs double")


def output_metrics(spark: SparkSession, folder: str, pattern: str = "*_betadata.feather") -> DataFrame:
    """One row: files, bytes and finished genes of a run's folder and all folders below it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.countDistinct(gene_of_file(F.col("path"))).alias("genes"))


def mean_recent_seconds(times: list[float]) -> float | None:
    own = times[-RECENT:]
    mean = sum(own) / len(own) if own else 0.0
    return mean if 0 < mean < float("inf") else None


def genes_per_second(finished: int, elapsed: float, times: list[float], workers: int = 1) -> float | None:
    """As observed, else as the recent genes' times suggest."""
    if finished > 0:
        return finished / max(elapsed, 0.001)
    mean = mean_recent_seconds(times)
    return max(workers, 1) / mean if mean else None


def seconds_left(pending: int, rate: float | None) -> float | None:
    return pending / rate if rate else None
