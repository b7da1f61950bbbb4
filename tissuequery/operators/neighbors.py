"""Radius and nearest-neighbour joins on the plane.

The radius join is an equi-join on grid squares of the radius' size: every cell is dealt to its own square and the
eight around it, so only near cells meet. The nearest-neighbour join deals points to boxes of about equal numbers (strips
by quantiles of x, boxes within a strip by quantiles of y), so clustered points and outliers are no matter: the k-th
neighbour in a point's own box bounds how far it must look, and then it meets the boxes that its circle touches. Exact.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 64
#: Bytes of links, and of values of a group of genes, up to which a task holds them whole in a permutation test; links of a step.
HELD_BYTES, LINKS = 32 << 20, 65_536


def finite(df: DataFrame, x: str, y: str) -> DataFrame:
    bad = [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in (x, y)]
    return df.where(~(bad[0] | bad[1]))


def within_radius(points: DataFrame, radius: float, key: str = "cell_idx", x: str = "x", y: str = "y") -> DataFrame:
    """i, j, d2 of all pairs at most the radius apart, a point with itself included."""
    p = finite(points, x, y).select(F.col(key).alias("i"), F.col(x).alias("xi"), F.col(y).alias("yi"), F.floor(F.col(x) / radius).alias("bx"), F.floor(F.col(y) / radius).alias("by"))
    around = F.explode(F.array(*(F.struct((F.col("bx") + dx).alias("bx"), (F.col("by") + dy).alias("by")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
    q = p.select(F.col("i").alias("j"), F.col("xi").alias("xj"), F.col("yi").alias("yj"), around.alias("b")).select("j", "xj", "yj", "b.bx", "b.by")
    d2 = (F.col("xi") - F.col("xj")) * (F.col("xi") - F.col("xj")) + (F.col("yi") - F.col("yj")) * (F.col("yi") - F.col("yj"))
    return p.join(q, ["bx", "by"]).select("i", "j", d2.alias("d2")).where(F.col("d2") <= radius * radius)


def _place(table: Column, bits: int, x: Column) -> Column:
    """How many of the sorted values in table are at most x: binary search."""

    def halve(at, step):
        nxt = at + step
        return F.when((nxt <= F.size(table)) & (F.get(table, (nxt - 1).cast("int")) <= x), nxt).otherwise(at)

    return F.aggregate(F.array(*(F.lit(1 << b) for b in reversed(range(max(1, bits))))), F.lit(0), halve)


def nearest(points: DataFrame, k: int, key: str = "cell_idx", x: str = "x", y: str = "y", per_box: int | None = None) -> DataFrame:
    """i, j, rank, d2: the k nearest other points of every point, ties to the smaller key. Exact."""
    p = cut(finite(points, x, y).select(F.col(key).alias("i"), F.col(x).alias("xi"), F.col(y).alias("yi")))
    n = p.count()
    if n < 2:
        return points.sparkSession.createDataFrame([], f"i {p.schema['i'].dataType.simpleString()}, j {p.schema['i'].dataType.simpleString()}, rank int, d2 double")
    k = min(k, n - 1)
    strips = max(1, int(math.sqrt(n / (per_box or max(48, 4 * k)))))
    shares, bits = [q / strips for q in range(1, strips)], strips.bit_length()
    none = F.array().cast("array<double>")

    def cuts(column):
        return F.array_distinct(F.array_sort(F.percentile_approx(column, shares, 100 * strips))) if shares else none

    across = F.lit(p.agg(cuts("xi").alias("c")).first()["c"] or []).cast("array<double>") if shares else none
    own = p.withColumn("strip", _place(across, bits, F.col("xi")))
    up = own.groupBy("strip").agg(cuts("yi").alias("ys")) if shares else own.select("strip", none.alias("ys")).distinct()
    up = cut(up)
    up = F.broadcast(up) if 8 * strips * strips <= 64 << 20 else up  # as many numbers as there are boxes
    own = cut(own.join(up, "strip").withColumn("box", _place(F.col("ys"), bits, F.col("yi"))).drop("ys"))
    # of points in one place only the k + 1 smallest keys can be among anyone's neighbours
    copies = Window.partitionBy("xi", "yi").orderBy("i")
    other = own.withColumn("c", F.row_number().over(copies)).where(F.col("c") <= k + 1)
    other = cut(other.select("strip", "box", F.col("i").alias("j"), F.col("xi").alias("xj"), F.col("yi").alias("yj")))
    d2 = (F.col("xi") - F.col("xj")) * (F.col("xi") - F.col("xj")) + (F.col("yi") - F.col("yj")) * (F.col("yi") - F.col("yj"))
    bound = own.join(other, ["strip", "box"]).where("i != j").groupBy("i").agg(F.get(F.sort_array(F.collect_list(d2)), k - 1).alias("far"))
    far = F.coalesce("far", F.lit(float("inf")))
    reach = F.sqrt(far) * (1 + 1e-9)
    mine = own.select("i", "xi", "yi").join(bound, "i", "left").select("i", "xi", "yi", far.alias("far"), reach.alias("r"))
    mine = mine.withColumn("strip", F.explode(F.sequence(_place(across, bits, F.col("xi") - F.col("r")), _place(across, bits, F.col("xi") + F.col("r")))))
    mine = mine.join(up, "strip").withColumn("box", F.explode(F.sequence(_place(F.col("ys"), bits, F.col("yi") - F.col("r")), _place(F.col("ys"), bits, F.col("yi") + F.col("r"))))).drop("ys", "r")
    near = mine.join(other, ["strip", "box"]).where("i != j").select("i", "j", "far", d2.alias("d2")).where("d2 <= far").drop("far")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d2", "j"))).where(F.col("rank") <= k).select("i", "j", "rank", "d2")


def symmetric(edges: DataFrame) -> DataFrame:
    """i, j in both directions, once each."""
    return edges.select("i", "j").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def from_one(points: DataFrame, key_value: int, key: str = "cell_idx", x: str = "x", y: str = "y") -> DataFrame:
    """j, d2 from one point to all others; the point's place is looked up once."""
    at = points.where(F.col(key) == key_value).select(x, y).first()
    d2 = (F.col(x) - at[0]) * (F.col(x) - at[0]) + (F.col(y) - at[1]) * (F.col(y) - at[1])
    return points.where(F.col(key) != key_value).select(F.col(key).alias("j"), d2.alias("d2"))


def neighbor_counts(points: DataFrame, radius: float) -> DataFrame:
    """cell_idx, cluster, n: neighbours within the radius by their cluster."""
    clusters = points.select(F.col("cell_idx").alias("j"), "cluster")
    return within_radius(points, radius).join(clusters, "j").groupBy(F.col("i").alias("cell_idx"), "cluster").agg(F.count("*").alias("n"))


def morans_i(residuals: DataFrame, edges: DataFrame) -> DataFrame:
    """gene, moran_i with binary weights; 0 below two cells, without variance or links. residuals: gene, cell_idx, e."""
    by = Window.partitionBy("gene")
    z = residuals.select("gene", "cell_idx", (F.col("e") - F.avg("e").over(by)).alias("z"))
    base = z.groupBy("gene").agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    linked = edges.join(z.select("gene", F.col("cell_idx").alias("i"), F.col("z").alias("zi")), "i").join(z.select("gene", F.col("cell_idx").alias("j"), F.col("z").alias("zj")), ["gene", "j"])
    sums = linked.groupBy("gene").agg(F.count("*").alias("s0"), F.sum(F.col("zi") * F.col("zj")).alias("zz_ij"))
    value = F.when((F.col("n") < 2) | (F.col("zz") <= 0) | F.col("s0").isNull(), 0.0).otherwise(F.col("n") / F.col("s0") * F.col("zz_ij") / F.col("zz"))
    return base.join(sums, "gene", "left").select("gene", value.alias("moran_i"))


def _hashes(perm: int, cells: np.ndarray) -> np.ndarray:
    """F.xxhash64 of a permutation (int) and cells (long)."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x, by):
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    def mixed(x):
        x = (x ^ (x >> np.uint64(33))) * two
        x = (x ^ (x >> np.uint64(29))) * three
        return x ^ (x >> np.uint64(32))

    first = np.array([42], np.uint64) + five + np.uint64(4)
    seed = mixed(turned(first ^ (np.array([perm], np.uint64) * one), 23) * two + three)
    x = (seed + five + np.uint64(8)) ^ (turned(cells.astype("<i8").view(np.uint64) * two, 31) * one)
    return mixed(turned(x, 27) * one + four).view(np.int64)


def _permuted_whole(residuals: DataFrame, edges: DataFrame, cells: DataFrame, genes: list[str], many: int, n: int) -> DataFrame | None:
    """moran_permutations() where a task can hold all links and the values of some genes: a deal is a task's own sort and
    the links are sums in place, so neither is moved. None where they are too many."""
    if n < 2 or 8 * n > HELD_BYTES or residuals.schema["cell_idx"].dataType.simpleString() != "bigint":
        return None
    spark = residuals.sparkSession
    links = cut(edges.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.count("*").alias("w")))
    if 10 * links.count() > HELD_BYTES:
        return None
    ids = np.sort(cells.select("cell_idx").toArrow()["cell_idx"].to_numpy())
    got = links.toArrow()
    ends = [got[c].to_numpy() for c in ("a", "b", "w")]
    a, b = (np.searchsorted(ids, x) for x in ends[:2])
    known = (a < n) & (b < n)
    known &= (ids[np.minimum(a, n - 1)] == ends[0]) & (ids[np.minimum(b, n - 1)] == ends[1])
    order = np.lexsort((b[known], a[known]))
    a, b, w = a[known][order].astype(np.int32), b[known][order].astype(np.int32), ends[2][known][order].astype(np.float64)
    s0 = float(w.sum())
    held = spark.sparkContext.broadcast((ids, a, b, w.astype(np.float32) if w.size and w.max() < 1 << 24 else w))
    tasks = max(1, min(many + 1, 4 * spark.sparkContext.defaultParallelism))
    deals = spark.range(0, many + 1, 1, tasks).select(F.col("id").alias("perm"))
    rows, step = [], max(1, min(BLOCK, HELD_BYTES // (8 * n)))
    for k in range(0, len(genes), BLOCK):
        own = genes[k : k + BLOCK]
        names = [f"z{g}" for g in range(len(own))]
        wide = residuals.where(F.col("gene").isin(own)).groupBy("cell_idx").agg(*(F.sum(F.when(F.col("gene") == g, F.col("e"))).alias(z) for g, z in zip(own, names)))
        wide = cut(wide)
        for start in range(0, len(own), step):
            some, cols = own[start : start + step], names[start : start + step]
            table = wide.select("cell_idx", *cols).toArrow()
            at = np.searchsorted(ids, table["cell_idx"].to_numpy())
            z, there = np.zeros((n, len(some))), []
            for c, name in enumerate(cols):
                x = table[name].to_numpy().astype(np.float64)
                there.append(table[name].null_count < len(x))
                has = ~np.isnan(x) if table[name].null_count else np.ones(len(x), bool)
                z[at[has], c] = x[has] - x[has].mean() if has.any() else 0.0
            del table
            squares, values = (z * z).sum(0), spark.sparkContext.broadcast(z)
            del z

            def run(batches, values=values):
                ids, a, b, w = held.value
                z = values.value
                for batch in batches:
                    for perm in batch.column("perm").to_pylist():
                        dealt = z if perm == 0 else z[np.argsort(_hashes(perm, ids), kind="stable")]
                        sums = np.zeros(z.shape[1])
                        for m in range(0, len(a), LINKS):
                            part = slice(m, m + LINKS)
                            sums += np.einsum("ij,ij,i->j", dealt[a[part]], dealt[b[part]], w[part].astype(np.float64))
                        yield pa.RecordBatch.from_arrays([pa.array([perm]), pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["perm", "sums"])

            sums = {r["perm"]: np.array(r["sums"]) for r in deals.mapInArrow(run, "perm long, sums array<double>").collect()}  # a row a deal
            values.destroy()
            for c, g in enumerate(some):
                if there[c]:
                    i = np.array([n / s0 * sums[p][c] / squares[c] if s0 and squares[c] > 0 else 0.0 for p in range(many + 1)])
                    hits = int((np.abs(i[1:]) >= abs(i[0]) - 1e-15).sum())
                    rows.append((g, float(i[0]), (1 + hits) / (1 + many) if s0 else 1.0))
    return spark.createDataFrame(rows, "gene string, moran_i double, p double")


def moran_permutations(residuals: DataFrame, edges: DataFrame, genes: list[str], many: int) -> DataFrame:
    """gene, moran_i, p: residuals are dealt anew to the cells `many` times, by hashes of (permutation, cell), and
    p = (1 + as extreme deals) / (1 + many). Links that fit HELD_BYTES go to the tasks whole (_permuted_whole). Beyond, all
    genes share the deals, so the links are moved once a deal and carry the genes side by side, in blocks of BLOCK. residuals: gene, cell_idx, e, every gene over all cells."""
    edges, cells = cut(edges.select("i", "j")), cut(residuals.select("cell_idx").distinct())
    whole = _permuted_whole(residuals, edges, cells, genes, many, cells.count())
    if whole is not None:
        return whole
    perms = cells.select("cell_idx", F.explode(F.sequence(F.lit(1), F.lit(many))).alias("perm"))
    place = Window.partitionBy("perm").orderBy("cell_idx")
    dealt = Window.partitionBy("perm").orderBy(F.xxhash64("perm", "cell_idx"), "cell_idx")
    ranked = perms.select("perm", "cell_idx", F.row_number().over(place).alias("a"), F.row_number().over(dealt).alias("b"))
    given = ranked.select("perm", F.col("a").alias("r"), "cell_idx").join(ranked.select("perm", F.col("b").alias("r"), F.col("cell_idx").alias("from")), ["perm", "r"]).select("perm", "cell_idx", "from")
    given = cut(given.union(cells.select(F.lit(0).alias("perm"), "cell_idx", F.col("cell_idx").alias("from"))))  # deal 0: as observed
    ends = [given.select("perm", F.col("cell_idx").alias(c), F.col("from").alias(f"from_{c}")) for c in ("i", "j")]
    moved = edges.join(ends[0], "i").join(ends[1], ["perm", "j"]).select("perm", "from_i", "from_j")
    n, out = cells.count(), None
    for k in range(0, len(genes), BLOCK):
        own = genes[k : k + BLOCK]
        names = [f"z{g}" for g in range(len(own))]
        wide = residuals.where(F.col("gene").isin(own)).groupBy("cell_idx").agg(*(F.sum(F.when(F.col("gene") == g, F.col("e"))).alias(z) for g, z in zip(own, names)))
        means = wide.agg(*(F.avg(z).alias(z) for z in names)).first()
        z = cut(wide.select("cell_idx", *((F.col(c) - F.lit(means[c])).alias(c) for c in names)))
        squares = z.agg(*(F.sum(F.col(c) * F.col(c)).alias(c) for c in names)).first()
        a, b = (z.select(F.col("cell_idx").alias(f"from_{e}"), *(F.col(c).alias(f"{c}_{e}") for c in names)) for e in ("i", "j"))
        sums = moved.join(a, "from_i").join(b, "from_j").groupBy("perm").agg(F.count("*").alias("s0"), *(F.sum(F.col(f"{c}_i") * F.col(f"{c}_j")).alias(c) for c in names))
        value = [F.lit(0.0) if n < 2 or not squares[c] or squares[c] <= 0 else F.lit(n) / F.col("s0") * F.col(c) / F.lit(squares[c]) for c in names]
        rows = sums.select("perm", F.explode(F.array(*(F.struct(F.lit(g).alias("gene"), v.alias("i")) for g, v in zip(own, value)))).alias("r")).select("perm", "r.gene", "r.i")
        seen = F.max(F.when(F.col("perm") == 0, F.col("i"))).over(Window.partitionBy("gene"))
        hits = F.sum(((F.col("perm") > 0) & (F.abs("i") >= F.abs("moran_i") - 1e-15)).cast("long"))
        part = rows.withColumn("moran_i", seen).groupBy("gene").agg(F.first("moran_i").alias("moran_i"), ((1 + hits) / (1 + many)).alias("p"))
        out = part if out is None else out.union(part)
    unlinked = residuals.select("gene").distinct().where(F.col("gene").isin(genes))
    return unlinked.join(out, "gene", "left").select("gene", F.coalesce("moran_i", F.lit(0.0)).alias("moran_i"), F.coalesce("p", F.lit(1.0)).alias("p"))
