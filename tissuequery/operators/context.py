"""What one cell may send to the cells around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import network

MOST_PAIRS = 48  # a neighbour's edges


def sender_edges(edges: DataFrame, expression: DataFrame, cell: int, near: DataFrame, threshold: float = 0.01, pairs: DataFrame | None = None) -> DataFrame:
    """j, ligand, receptor, score, tf: ligand-receptor edges from the cell to the cells in `near` (j), both expressed above
    the threshold, score sqrt(L R), the first 48 a neighbour in pair order, each with the linked factor that the sender
    expresses most (or ''). One cell's genes and its near cells are few, so they are broadcast."""
    own = F.broadcast(expression.where((F.col("cell_idx") == cell) & (F.col("value") > threshold)).select("gene", "value"))
    chosen = network.lr_pairs(edges) if pairs is None else pairs
    sent = chosen.join(own.select(F.col("gene").alias("ligand"), F.col("value").alias("l")), "ligand")
    theirs = expression.where(F.col("value") > threshold).join(F.broadcast(near.select("j")), F.col("cell_idx") == F.col("j")).select("j", F.col("gene").alias("receptor"), F.col("value").alias("r"))
    by = Window.partitionBy("j").orderBy("pair_order")
    found = theirs.join(F.broadcast(sent), "receptor").withColumn("k", F.row_number().over(by)).where(F.col("k") <= MOST_PAIRS)
    factor = edges.where("edge_type = 'nichenet'").join(own.select(F.col("gene").alias("target"), "value"), "target").groupBy(F.col("source").alias("ligand")).agg(F.max_by("target", F.struct("value", "target")).alias("tf"))
    return found.join(F.broadcast(factor), "ligand", "left").select("j", "ligand", "receptor", F.sqrt(F.col("l") * F.col("r")).alias("score"), F.coalesce("tf", F.lit("")).alias("tf"))
