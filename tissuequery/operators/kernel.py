"""Received ligands: the Gaussian kernel over all pairs of cells, and its grid approximation.

received(i, l) = (1 / N) * sum over j of scale * exp(-d(i, j)^2 / (2 r^2)) * L(j, l), the cell itself included.

The exact form is quadratic in the cells by definition; with a grid factor the sum is taken at anchors, whose number
depends on the area and the radius, not on the cells, and carried to the cells by bilinear interpolation. received()
plans for a training design: exact up to GRID_FROM cells, on the grid above or when asked for.

The exact sum is not taken pair by pair where there are many: see Fast. Every pair counts, in time that grows with cells.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells in a block, and the bytes of all blocks of sources up to which they are broadcast; more are joined by shuffle.
BLOCK, BROADCAST_BYTES = 2048, 64 << 20
GRID_FROM, GRID_FACTOR = 15_000, 0.5
THRESHOLD = 1e-9
#: Nodes a box side of one radius, for which the weight's error is below that of a double (see Fast); pairs of places and
#: sources up to which pairs are taken one by one; and the nodes on an axis up to which boxes are used.
NODES, PAIRS, MOST_NODES = 16, 4096 * 4096, 4096


class Fast:
    """The sum over all sources through the kernel's own smoothness. The plane is cut into boxes with sides of one radius.
    On a side the weight exp(-t^2 / 2), as a function of one end, is the polynomial through its values at NODES Chebyshev
    points, up to 2 (1/4)^p / p! times its largest p-th derivative, which is sqrt(p!) at most: 1e-16 for p = 16. So a
    source is spread over its box's nodes, nodes meet nodes (two matrix products, as the weight is a product of one of x
    and one of y), and a place reads its box's nodes. No pair is left out; the error is that of double sums, absolute, on
    the scale of the mean value."""

    def __init__(self, x0: float, y0: float, x1: float, y1: float, radius: float):
        self.x0, self.y0, self.radius = x0, y0, radius
        self.nx, self.ny = int((x1 - x0) / radius) + 1, int((y1 - y0) / radius) + 1
        self.at = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))  # on (-1, 1)
        self.sign = (-1.0) ** np.arange(NODES) * np.sin((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))

    def place(self, x: np.ndarray, low: float, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The box on an axis, and the nodes' shares (barycentric)."""
        box = np.clip(((x - low) / self.radius).astype(np.int64), 0, n - 1)
        t = 2.0 * ((x - low) / self.radius - box) - 1.0
        gap = t[:, None] - self.at
        hit = gap == 0
        w = self.sign / np.where(hit, 1.0, gap)
        w = np.where(hit.any(1)[:, None], hit.astype(np.float64), w)
        return box, w / w.sum(1, keepdims=True)

    def boxes(self, x: np.ndarray, y: np.ndarray):
        """For the rows of each box: box on x, box on y, rows, shares on x and on y."""
        (bx, wx), (by, wy) = self.place(x, self.x0, self.nx), self.place(y, self.y0, self.ny)
        key = bx * self.ny + by
        order = np.argsort(key, kind="stable")
        ends = [0, *(np.flatnonzero(np.diff(key[order])) + 1), len(order)]
        for start, end in zip(ends, ends[1:]):
            rows = order[start:end]
            if len(rows):
                yield int(bx[rows[0]]), int(by[rows[0]]), rows, wx[rows], wy[rows]

    def spread(self, sums: np.ndarray, x: np.ndarray, y: np.ndarray, values: np.ndarray) -> None:
        """Add sources to sums, of values by nodes on x by nodes on y. values: sources by columns."""
        for bx, by, rows, wx, wy in self.boxes(x, y):
            own = sums[:, bx * NODES : (bx + 1) * NODES, by * NODES : (by + 1) * NODES]
            for c in range(values.shape[1]):
                own[c] += (wx * values[rows, c][:, None]).T @ wy

    def shape(self) -> tuple[int, int]:
        return self.nx * NODES, self.ny * NODES

    def met(self, sums: np.ndarray) -> np.ndarray:
        """Nodes meet nodes."""

        def weights(n):
            t = (np.arange(n)[:, None] + (self.at + 1.0) / 2.0).ravel()  # in radii
            return np.exp(-0.5 * (t[:, None] - t) ** 2)

        kx, ky = weights(self.nx), weights(self.ny)
        return np.array([kx @ m @ ky for m in sums]) if len(sums) else sums

    def read(self, met: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places by columns."""
        out = np.zeros((len(x), len(met)))
        for bx, by, rows, wx, wy in self.boxes(x, y):
            own = met[:, bx * NODES : (bx + 1) * NODES, by * NODES : (by + 1) * NODES]
            for c in range(len(met)):
                out[rows, c] = ((wx @ own[c]) * wy).sum(1)
        return out


class Signal:
    """Received signals of columns with radii: what the sources of a table give, and what places receive of it. None of
    Spark in it but total()."""

    def __init__(self, box: tuple, radii: list[float]):
        self.radii = radii
        self.fast = {r: Fast(*box, r) for r in sorted(set(radii))}
        self.own = {r: [k for k, q in enumerate(radii) if q == r] for r in self.fast}

    def fits(self) -> bool:
        return all(max(f.shape()) <= MOST_NODES for f in self.fast.values()) and sum(8 * len(self.own[r]) * f.shape()[0] * f.shape()[1] for r, f in self.fast.items()) <= BROADCAST_BYTES // 2

    def empty(self) -> dict:
        return {r: np.zeros((len(self.own[r]), *f.shape())) for r, f in self.fast.items()}

    def add(self, sums: dict, x: np.ndarray, y: np.ndarray, values: np.ndarray) -> None:
        for r, f in self.fast.items():
            f.spread(sums[r], x, y, values[:, self.own[r]])

    def total(self, given: DataFrame, values) -> dict:
        """The nodes' sums over all rows of given (with x and y), met. values: a batch's columns of sources. A partition
        gives one row a radius and column; they are added up by column, so the driver gets as many as there are columns."""

        def run(batches):
            sums, any_ = self.empty(), False
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    self.add(sums, part.column("x").to_numpy(), part.column("y").to_numpy(), values(part))
                    any_ = True
            if any_:
                for r, s in sums.items():
                    for c, m in zip(self.own[r], s):
                        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["k", "m"])

        def added(batches):  # partial sums of a column, one after another
            sums = {}
            for batch in batches:
                for k, m in zip(batch.column("k").to_pylist(), batch.column("m")):
                    m = np.frombuffer(m.as_buffer(), "<f8")
                    sums[k] = sums[k] + m if k in sums else m.copy()
            for k, m in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["k", "m"])

        kind = "k int, m binary"
        parts = given.mapInArrow(run, kind).repartition(len(self.radii), "k").mapInArrow(added, kind)
        sums = self.empty()
        for k, m in parts.collect():  # a row a column
            r = self.radii[k]
            sums[r][self.own[r].index(k)] += np.frombuffer(m, "<f8").reshape(self.fast[r].shape())
        return {r: f.met(sums[r]) for r, f in self.fast.items()}

    def read(self, met: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.radii)))
        for r, f in self.fast.items():
            out[:, self.own[r]] = f.read(met[r], x, y)
        return out


def signal_over(cells: DataFrame, radii: list[float], n: int) -> Signal | None:
    """None if pairs are few, a coordinate is not finite, or boxes would be too many: then pairs are taken one by one."""
    if not radii or n * n <= PAIRS or not all(0 < r < math.inf for r in radii):
        return None
    odd = [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in ("x", "y")]
    some, x0, y0, x1, y1 = cells.agg(F.coalesce(F.max(odd[0] | odd[1]), F.lit(True)), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if some or max(x1 - x0, y1 - y0) / min(radii) * NODES > MOST_NODES:
        return None
    signal = Signal((x0, y0, x1, y1), list(radii))
    return signal if signal.fits() else None


def wide(cells: DataFrame, values: DataFrame, ligands: list[str], threshold: float | None = None) -> DataFrame:
    """cell_idx, x, y, one column a ligand (l0, l1, ...), zero where a cell has none, and some: whether one isn't zero.
    (A filter over all the columns would make the optimizer's constraints grow exponentially with the ligands.)"""
    v = F.col("value") if threshold is None else F.when(F.col("value") > threshold, F.col("value")).otherwise(0.0)
    sums = [F.sum(F.when(F.col("gene") == g, v)).alias(f"l{k}") for k, g in enumerate(ligands)]
    pivoted = values.where(F.col("gene").isin(ligands)).groupBy("cell_idx").agg(*sums, F.max(v != 0).alias("some"))
    out = cells.select("cell_idx", "x", "y").join(pivoted, "cell_idx", "left")
    return out.select("cell_idx", "x", "y", *(F.coalesce(f"l{k}", F.lit(0.0)).alias(f"l{k}") for k in range(len(ligands))), F.coalesce("some", F.lit(False)).alias("some"))


def _long(df: DataFrame, ligands: list[str], keys: list[str]) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(g).alias("gene"), F.col(f"l{k}").alias("value")) for k, g in enumerate(ligands))))
    return df.select(*keys, rows.alias("r")).select(*keys, "r.gene", "r.value")


def _blocks(df: DataFrame, columns: list[str], blocks: int, name: str) -> DataFrame:
    """Rows dealt to blocks by a hash of their first column, a whole number; each block's numbers as one matrix."""

    def run(own: pa.Table) -> pa.Table:
        x = np.column_stack([own[c].to_numpy().astype(np.float64) for c in columns[1:]])
        keys = own[columns[0]].to_numpy().astype("<i8")
        return pa.table({name: own[name].slice(0, 1).cast(pa.int32()), f"{name}_keys": pa.array([keys.tobytes()], pa.binary()), f"{name}_data": pa.array([x.astype("<f8").tobytes()], pa.binary())})

    dealt = df.select(*columns, F.pmod(F.xxhash64(columns[0]), F.lit(blocks)).cast("int").alias(name))
    return dealt.groupBy(name).applyInArrow(run, f"{name} int, {name}_keys binary, {name}_data binary")


def _summed(places: DataFrame, sources: DataFrame, radii: list[float], key: str, scale: float, n: int, many: int | None = None) -> DataFrame:
    """The kernel sum at every place: blocks of places meet blocks of sources, a matrix product each. Each weight is worked
    out once a distinct radius; weights below the smallest double are zero by themselves."""
    many = n if many is None else many
    width = len(radii)
    p = _blocks(places, [key, "x", "y"], max(1, -(-many // BLOCK)), "p")
    blocks = max(1, -(-n // BLOCK))
    src = _blocks(sources, ["cell_idx", "x", "y", *(f"l{k}" for k in range(width))], blocks, "s").drop("s_keys")
    if n * (width + 2) * 8 <= BROADCAST_BYTES:
        pairs = p.join(F.broadcast(src))
    else:
        pairs = p.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(src, "s")
    distinct = sorted(set(radii))
    factor = scale / max(n, 1)

    def run(batches):
        at, keys, sums, xy = None, None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(c)) for c in sums.T)], names=["key", *(f"l{k}" for k in range(width))])

        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column("p")[row].as_py()
                if block != at:
                    if at is not None:
                        yield out()
                    at, keys = block, np.frombuffer(batch.column("p_keys")[row].as_py(), "<i8")
                    xy, sums = np.frombuffer(batch.column("p_data")[row].as_py(), "<f8").reshape(-1, 2), np.zeros((len(keys), width))
                s = np.frombuffer(batch.column("s_data")[row].as_py(), "<f8").reshape(-1, 2 + width)
                d2 = (xy[:, :1] - s[:, 0]) ** 2 + (xy[:, 1:] - s[:, 1]) ** 2
                for r in distinct:
                    own = [k for k, q in enumerate(radii) if q == r]
                    sums[:, own] += np.exp(d2 * (-1.0 / (2.0 * r * r))) @ s[:, [2 + k for k in own]]
        if at is not None:
            yield out()

    ordered = pairs.select("p", "p_keys", "p_data", "s_data")
    got = ordered.mapInArrow(run, "key long, " + ", ".join(f"l{k} double" for k in range(width)))
    return got.groupBy(F.col("key").alias(key)).agg(*((F.sum(f"l{k}") * factor).alias(f"l{k}") for k in range(width)))


def exact(cells: DataFrame, values: DataFrame, ligands: list[str], radii: list[float], scale: float = 1.0, threshold: float | None = None, n: int | None = None) -> DataFrame:
    """cell_idx, gene, value of every cell and ligand."""
    sources = wide(cells, values, ligands, threshold)
    n = cells.count() if n is None else n
    signal = signal_over(cells, radii, n)
    if signal is not None:
        names = [f"l{k}" for k in range(len(ligands))]
        met = cells.sparkSession.sparkContext.broadcast(signal.total(sources.where("some").drop("cell_idx", "some"), lambda b: np.column_stack([b.column(c).to_numpy() for c in names])))
        factor = scale / max(n, 1)

        def run(batches):
            for batch in batches:
                x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
                for start in range(0, len(x), BLOCK):
                    own = signal.read(met.value, x[start : start + BLOCK], y[start : start + BLOCK]) * factor
                    ids = batch.column("cell_idx").slice(start, BLOCK)
                    at = ids.take(pa.array(np.repeat(np.arange(len(ids)), len(ligands))))
                    yield pa.RecordBatch.from_arrays([at, pa.array(ligands * len(ids), pa.string()), pa.array(own.ravel())], names=["cell_idx", "gene", "value"])

        return cells.select("cell_idx", "x", "y").mapInArrow(run, f"cell_idx {cells.schema['cell_idx'].dataType.simpleString()}, gene string, value double")
    got = _summed(cells.select("cell_idx", "x", "y"), sources.where("some"), radii, "cell_idx", scale, n)
    got = cells.select("cell_idx").join(got, "cell_idx", "left").select("cell_idx", *(F.coalesce(f"l{k}", F.lit(0.0)).alias(f"l{k}") for k in range(len(ligands))))
    return _long(got, ligands, ["cell_idx"])


def on_grid(cells: DataFrame, values: DataFrame, ligands: list[str], radius: float, factor: float = GRID_FACTOR, scale: float = 1.0, threshold: float | None = None) -> DataFrame:
    """The kernel at anchors a step of radius * factor apart, one step beyond the cells on each side, and bilinear
    interpolation; exact if there would be as many anchors as cells."""
    step = radius * factor
    n, x0, x1, y0, y1 = cells.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n:
        return exact(cells, values, ligands, [radius] * len(ligands), scale, threshold, 0)
    x0, y0 = x0 - step, y0 - step
    nx, ny = math.ceil((x1 + step - x0) / step) + 1, math.ceil((y1 + step - y0) / step) + 1
    if nx * ny >= n:
        return exact(cells, values, ligands, [radius] * len(ligands), scale, threshold, n)
    sources = wide(cells, values, ligands, threshold)
    places = cells.sparkSession.range(nx * ny).select(F.col("id").alias("anchor"), (F.lit(x0) + (F.col("id") % nx) * F.lit(step)).alias("x"), (F.lit(y0) + F.floor(F.col("id") / nx) * F.lit(step)).alias("y"))
    anchors = _summed(places, sources.where("some"), [radius] * len(ligands), "anchor", scale, n, nx * ny)
    gx, gy = (F.col("x") - F.lit(x0)) / F.lit(step), (F.col("y") - F.lit(y0)) / F.lit(step)
    placed = cells.select("cell_idx", F.floor(gx).alias("ix"), F.floor(gy).alias("iy"), gx.alias("gx"), gy.alias("gy")).withColumn("fx", F.col("gx") - F.col("ix")).withColumn("fy", F.col("gy") - F.col("iy"))
    corner = F.explode(
        F.array(
            *(
                F.struct((F.least(F.col("iy") + dy, F.lit(ny - 1)) * nx + F.least(F.col("ix") + dx, F.lit(nx - 1))).alias("anchor"), ((F.col("fx") if dx else 1 - F.col("fx")) * (F.col("fy") if dy else 1 - F.col("fy"))).alias("w"))
                for dy in (0, 1)
                for dx in (0, 1)
            )
        )
    )
    corners = placed.select("cell_idx", corner.alias("c")).select("cell_idx", "c.anchor", "c.w").join(F.broadcast(anchors) if nx * ny * (len(ligands) + 1) * 8 <= BROADCAST_BYTES else anchors, "anchor")
    got = corners.groupBy("cell_idx").agg(*(F.sum(F.col("w") * F.col(f"l{k}")).alias(f"l{k}") for k in range(len(ligands))))
    return _long(got, ligands, ["cell_idx"])


def received(cells: DataFrame, values: DataFrame, ligands: list[str], radii: list[float], scale: float = 1.0, threshold: float | None = None, factor: float | None = None) -> DataFrame:
    """The planner: exact, or by groups of equal radius on the grid."""
    n = cells.count()
    if factor is None and n <= GRID_FROM:
        return exact(cells, values, ligands, radii, scale, threshold, n)
    out = None
    for r in sorted(set(radii)):
        own = on_grid(cells, values, [g for g, q in zip(ligands, radii) if q == r], r, factor or GRID_FACTOR, scale, threshold)
        out = own if out is None else out.union(own)
    return out
