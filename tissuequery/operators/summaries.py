"""Plain aggregates, rankings and scalings of cells, expression and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import condition_or_missing, sanitized_condition


def dense(cells: DataFrame, expression: DataFrame, genes: DataFrame) -> DataFrame:
    """cell_idx, gene, value for all cells and genes; absent values are 0."""
    return cells.select("cell_idx").join(F.broadcast(genes.select("gene"))).join(expression, ["cell_idx", "gene"], "left").select("cell_idx", "gene", F.coalesce("value", F.lit(0.0)).alias("value"))


def gene_expression(cells: DataFrame, expression: DataFrame, gene: str) -> DataFrame:
    return cells.select("cell_idx").join(expression.where(F.col("gene") == gene), "cell_idx", "left").select("cell_idx", F.coalesce("value", F.lit(0.0)).alias("value"))


def gene_means(cells: DataFrame, expression: DataFrame, genes: DataFrame) -> DataFrame:
    """gene, mean over all cells, zeros counted: sums of the sparse table over the number of cells."""
    n = cells.count()
    got = expression.join(cells.select("cell_idx"), "cell_idx", "left_semi").groupBy("gene").agg((F.sum("value") / max(n, 1)).alias("mean"))
    return genes.select("gene").join(got, "gene", "left").select("gene", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def cluster_means(cells: DataFrame, expression: DataFrame, genes: list[str]) -> DataFrame:
    """cluster, gene, mean, n for the genes asked for; unknown genes are 0."""
    n = cells.groupBy("cluster").agg(F.count("*").alias("n"))
    sums = expression.where(F.col("gene").isin(genes)).join(cells.select("cell_idx", "cluster"), "cell_idx").groupBy("cluster", "gene").agg(F.sum("value").alias("s"))
    asked = n.select("cluster", "n", F.explode(F.array(*(F.lit(g) for g in genes))).alias("gene"))
    return asked.join(sums, ["cluster", "gene"], "left").select("cluster", "gene", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"), "n")


def label_counts(cells: DataFrame) -> DataFrame:
    return cells.where(F.trim("cell_type") != "").groupBy("cell_type").agg(F.count("*").alias("n"))


def majority_label(cells: DataFrame) -> DataFrame:
    """cluster, cell_type: the most frequent label, ties by label."""
    by = Window.partitionBy("cluster").orderBy(F.desc("n"), "cell_type")
    return cells.groupBy("cluster", "cell_type").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(by)).where("r = 1").select("cluster", "cell_type")


def label_codes(cells: DataFrame, unknown: int = 65535) -> DataFrame:
    """cell_idx, code: the label's place among the sorted distinct labels; blank is unknown."""
    label = F.when(F.trim("cell_type") != "", F.trim("cell_type"))
    codes = cells.select(label.alias("l")).where("l IS NOT NULL").distinct()
    codes = codes.withColumn("code", F.row_number().over(Window.orderBy("l")) - 1)  # one row a label
    return cells.select("cell_idx", label.alias("l")).join(F.broadcast(codes), "l", "left").select("cell_idx", F.coalesce("code", F.lit(unknown)).cast("int").alias("code"))


def condition_groups(cells: DataFrame) -> DataFrame:
    """condition, directory, n: groups of rows with file-safe names, equal ones numbered from _2 on."""
    groups = cells.groupBy(condition_or_missing(F.col("condition")).alias("condition")).agg(F.count("*").alias("n"))
    groups = groups.withColumn("base", sanitized_condition(F.col("condition")))
    rank = F.row_number().over(Window.partitionBy("base").orderBy("condition"))
    return groups.select("condition", F.when(rank == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), rank.cast("string"))).alias("directory"), "n")


def scaled_by_cluster(cells: DataFrame, values: DataFrame, symmetric: bool = False) -> DataFrame:
    """cell_idx, scaled: min-max within the cluster, or symmetric about 0 by the largest size; a cluster of zeros has no
    signal (null), of equal values 0.5 where not symmetric."""
    by = Window.partitionBy("cluster")
    v = values.join(cells.select("cell_idx", "cluster"), "cell_idx").select("cell_idx", "value", F.min("value").over(by).alias("lo"), F.max("value").over(by).alias("hi"))
    low, high = F.col("lo"), F.col("hi")
    most = F.greatest(F.abs(low), F.abs(high))
    scaled = (F.col("value") + most) / (2 * most) if symmetric else F.when(high - low < 1e-12, 0.5).otherwise((F.col("value") - low) / (high - low))
    return v.select("cell_idx", F.when(most > 0, scaled).alias("scaled"))


def rank_quantiles(values: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """One row: nearest-rank quantiles, the value at place floor(q (n - 1)) in order, without one global sort.

    percentile_disc takes the ceil(p n)-th value; p is chosen so that this is the place asked for."""
    n = values.count()
    cols = [F.expr(f"percentile_disc({(int(q * (n - 1)) + 0.5) / max(n, 1)!r}) WITHIN GROUP (ORDER BY value)").alias(name) for name, q in quantiles.items()]
    return values.agg(*cols)


def training_rollup(summaries: DataFrame) -> DataFrame:
    """gene, clusters, mean, least and largest R2, the share that converged. summaries: gene, cluster, r2, converged."""
    return summaries.groupBy("gene").agg(F.count("*").alias("clusters"), F.avg("r2").alias("mean_r2"), F.min("r2").alias("min_r2"), F.max("r2").alias("max_r2"), F.avg(F.col("converged").cast("double")).alias("converged"))


def spatial_map(cells: DataFrame, m: int, n: int) -> DataFrame:
    """cell_idx, cluster, i, j, value: one over the distance to each square's centre, rows from the top; the cluster
    axis is never made. Cells without finite coordinates are left out."""
    ok = cells.where(~(F.isnan("x") | F.isnan("y")) & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    x0, x1, y0, y1 = ok.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    w, h = max((x1 or 0) - (x0 or 0), 1e-6) / n, max((y1 or 0) - (y0 or 0), 1e-6) / m
    squares = F.explode(F.sequence(F.lit(0), F.lit(m * n - 1))).alias("k")
    out = ok.select("cell_idx", "cluster", "x", "y", squares).select("cell_idx", "cluster", "x", "y", F.floor(F.col("k") / n).alias("i"), (F.col("k") % n).cast("long").alias("j"))
    dx, dy = F.col("x") - (F.lit(x0) + (F.col("j") + 0.5) * w), F.col("y") - (F.lit(y1) - (F.col("i") + 0.5) * h)
    return out.select("cell_idx", "cluster", "i", "j", (1.0 / F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-6))).alias("value"))


def gate(inputs: DataFrame, base_r2: float = 0.1, permissiveness: float = 0.5, p_base: float = 0.05, p_strict: float = 0.01, least_cells: int = 50, most_terms: int = 40, weight: float = 1.0) -> DataFrame:
    """The ordered decision whether a gene gets the neural refinement. inputs: gene, skip, force, min_cells, converged,
    mean_r2, n_mods, n_spatial (pair terms), p. Adds use, reason, rank_score."""
    least_r2 = max(0.0, base_r2 * (1.4 - 0.8 * permissiveness))
    p_max, strict = min(max(p_base * (0.3 + 1.4 * permissiveness), 0.0), 1.0), min(max(p_strict * (0.3 + 1.4 * permissiveness), 0.0), 1.0)
    many = F.col("n_mods") > most_terms
    reason = (
        F.when(F.col("skip"), "skip list").when(F.col("force"), "allow list").when(F.col("min_cells") < least_cells, "few cells").when(~F.col("converged"), "not converged")
        .when(F.col("mean_r2") < least_r2, "low r2").when(many & (F.col("p") > strict), "many terms").when(~many & (F.col("p") > p_max), "no pattern").otherwise("pattern")
    )
    p = F.when(F.col("skip"), 1.0).otherwise(F.col("p"))
    frac = F.when(F.col("n_mods") > 0, F.col("n_spatial") / F.col("n_mods")).otherwise(0.0)
    score = -F.log(F.greatest(p, F.lit(1e-300))) + weight * frac + F.col("mean_r2")
    return inputs.withColumn("reason", reason).withColumn("use", F.col("reason").isin("allow list", "pattern")).withColumn("rank_score", score)


def expression_table(cells: DataFrame, expression: DataFrame, genes: list[str]) -> DataFrame:
    """cell_idx and a column a gene, in the order asked for; absent values and unknown genes are 0."""
    sums = [F.coalesce(F.sum(F.when(F.col("gene") == g, F.col("value"))), F.lit(0.0)).alias(g) for g in genes]
    got = expression.where(F.col("gene").isin(genes)).groupBy("cell_idx").agg(*sums)
    return cells.select("cell_idx").join(got, "cell_idx", "left").fillna(0.0, genes)


def target_genes(genes: DataFrame, listed: list[str] | None = None, most: int | None = None) -> DataFrame:
    """gene_idx, gene: the listed genes in variable order, the first `most` of them."""
    out = genes if listed is None else genes.where(F.col("gene").isin(listed))
    return out.select("gene_idx", "gene") if most is None else out.select("gene_idx", "gene").orderBy("gene_idx").limit(most)


def highlighted(cells: DataFrame, labels: list[str]) -> DataFrame:
    """cell_idx, keep: whether the cell's label is among those asked for; a cell without one is left out."""
    if cells.where(F.trim("cell_type").isin(labels)).isEmpty():
        raise ValueError("no cell has a label of " + ", ".join(labels))
    return cells.select("cell_idx", F.coalesce(F.trim("cell_type").isin(labels), F.lit(False)).alias("keep"))


def flat_maps(maps: DataFrame, m: int, n: int) -> DataFrame:
    """cell_idx, column, value: own-cluster maps as sparse rows over all clusters' squares."""
    return maps.select("cell_idx", (F.col("cluster") * (m * n) + F.col("i") * n + F.col("j")).cast("long").alias("column"), "value")
