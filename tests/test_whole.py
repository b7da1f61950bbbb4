"""The queries do the whole job: all genes, targets, cells and ligands."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuequery.operators import betas, kernel, neighbors, perturb, transition
from tissuequery.plans.registry import QUERIES, SQL

from test_queries import rows

GENES = [f"G{i:02d}" for i in range(64)]


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{sf_dir}/embeddings.parquet')")
    return c


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or isinstance(p, float) and abs(p - q) < 2e-5 for p, q in zip(x, y)), (x, y)


def test_moran_i_of_all_genes(spark, duck, sf_dir):
    got = QUERIES["moran_i"](spark, sf_dir).toPandas()
    assert sorted(got["gene"]) == GENES
    same(got, duck.execute(SQL["moran_i"]).fetchdf())


def test_moran_p_by_brute_force(spark):
    n, many, rng = 40, 99, np.random.default_rng(3)
    values = {"flat": np.ones(n), "noise": rng.normal(size=n), "trend": np.arange(n, dtype=float)}
    ids = [3 * i + 1 for i in range(n)]
    e = spark.createDataFrame([(g, c, float(x)) for g, v in values.items() for c, x in zip(ids, v)], "gene string, cell_idx long, e double")
    edges = neighbors.symmetric(spark.createDataFrame([(a, b) for k in (1, 2) for a, b in zip(ids, ids[k:])], "i long, j long"))
    got = {r["gene"]: (r["moran_i"], r["p"]) for r in neighbors.moran_permutations(e, edges, sorted(values), many).collect()}
    hashed = spark.createDataFrame([(c,) for c in ids], "c long").select("c", F.explode(F.sequence(F.lit(1), F.lit(many))).alias("p")).select("p", "c", F.xxhash64("p", "c").alias("h")).collect()
    w = np.zeros((n, n))
    for r in edges.collect():
        w[ids.index(r["i"]), ids.index(r["j"])] = 1

    def moran(x):
        z = x - x.mean()
        return n / w.sum() * (z @ w @ z) / (z @ z) if z @ z > 0 else 0.0

    for g, x in values.items():
        seen = moran(x)
        deals = [[ids.index(c) for _, c in sorted((r["h"], r["c"]) for r in hashed if r["p"] == p)] for p in range(1, many + 1)]
        hits = sum(abs(moran(x[d])) >= abs(seen) - 1e-15 for d in deals)
        assert got[g] == pytest.approx((seen, (1 + hits) / (1 + many)))
    assert got["trend"][1] == 0.01 and got["flat"] == (0, 1)


def test_moran_p_of_all_genes(spark, sf_dir):
    got = QUERIES["moran_p"](spark, sf_dir).toPandas()
    assert sorted(got["gene"]) == GENES
    assert all(abs(100 * p - round(100 * p)) < 1e-9 and 0.01 <= p <= 1 for p in got["p"]) and any(round(100 * p) % 5 for p in got["p"])
    assert dict(zip(got["gene"], got["moran_i"])) == pytest.approx({r["gene"]: r["moran_i"] for r in QUERIES["moran_i"](spark, sf_dir).collect()}, abs=2e-6)


TARGETS = GENES[::8]


@pytest.mark.parametrize("name", ["design_matrix", "predict_lasso", "fit_quality"])
def test_all_targets(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(set(got["target"])) == TARGETS
    same(got, duck.execute(SQL[name]).fetchdf())


def test_lasso_fit_of_all_targets(spark, sf_dir):
    got = QUERIES["lasso_fit"](spark, sf_dir).toPandas()
    assert sorted(set(got["target"])) == TARGETS
    clusters = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy("label").count().toPandas()
    for t in TARGETS:
        own = got[got["target"] == t]
        assert dict(zip(own["cluster"], own["n_cells"])) == dict(zip(clusters["label"], clusters["count"]))


@pytest.mark.parametrize("name", ["interactions", "quick_delta", "tfl_pairs", "modulator_terms"])
def test_all_cells_genes_and_ligands(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    same(got, duck.execute(SQL[name]).fetchdf())
    if name == "quick_delta":
        assert sorted(set(got["gene"])) == GENES
    if name == "tfl_pairs":
        assert got["ligand"].max() >= "G20"
    if name == "modulator_terms":
        assert got[got["term_type"] == "lr"]["a"].max() >= "G08"


def test_interactions_of_a_scope(spark):
    cells = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)], "cell_idx long, cluster int")
    b = spark.createDataFrame([(0, "T", "tf", "A", None, 1.0), (1, "T", "tf", "A", None, -0.5)], "cluster int, target string, term_type string, a string, b string, beta double")
    all_, some = (betas.interactions(c, b).first() for c in (cells, cells.where("cell_idx % 2 = 0")))
    assert (all_["sum"], all_["mean"], some["sum"], some["mean"]) == pytest.approx((0.5, 0.1, 0.0, 0.0))


def test_perturbation_is_exact_at_any_size(spark, monkeypatch):
    n, rng = 300, np.random.default_rng(5)
    at = rng.uniform(0, 200, (n, 2))
    cells = spark.createDataFrame([(i, f"c{i}", float(x), float(y), 0, "a", "k") for i, (x, y) in enumerate(at)], "cell_idx long, cell_id string, x double, y double, cluster int, cell_type string, condition string")
    dense = spark.createDataFrame([(i, g, float(rng.uniform(0, 5))) for i in range(n) for g in "LRT"], "cell_idx long, gene string, value double")
    b = spark.createDataFrame([(0, "T", "lr", "L", "R", 0.5)], "cluster int, target string, term_type string, a string, b string, beta double")
    wanted = cells.where("cell_idx % 3 = 0").select("cell_idx", F.lit("L").alias("gene"), F.lit(0.0).alias("desired"))

    def deltas(**k):
        return {(r["cell_idx"], r["gene"]): r["delta"] for r in perturb.propagate(cells, dense, b, wanted, {"L": 50.0}, 1, **k).collect()}

    want = deltas()
    monkeypatch.setattr(kernel, "GRID_FROM", 100)  # 300 cells are many, and more than the grid's anchors
    got, grid = deltas(), deltas(factor=0.5)
    assert got == pytest.approx(want, abs=1e-12)
    assert max(abs(grid[k] - want[k]) for k in want) > 1e-4


def test_planner_takes_the_grid_above_its_bound(spark, monkeypatch):
    cells = spark.createDataFrame([(i, float(i % 20), float(i // 20)) for i in range(400)], "cell_idx long, x double, y double")
    v = spark.createDataFrame([(i, "L", float(i % 7)) for i in range(400)], "cell_idx long, gene string, value double")

    def received():
        return [r["value"] for r in kernel.received(cells, v, ["L"], [4.0]).orderBy("cell_idx").collect()]

    exact = received()
    monkeypatch.setattr(kernel, "GRID_FROM", 400)
    assert received() == pytest.approx(exact, abs=1e-12)
    monkeypatch.setattr(kernel, "GRID_FROM", 399)
    assert max(abs(a - b) for a, b in zip(received(), exact)) > 1e-6


def test_all_correlations_write_blocks_once(spark):
    """disk grows with the cells, not with their square; near pairs keep their digits."""
    rng = np.random.default_rng(8)
    x, d = rng.normal(size=(1200, 16)), np.round(rng.normal(size=(1200, 16)), 3)
    x[1:40] = x[0] + 1e-7 * rng.normal(size=(39, 16))
    x[40] = x[0]
    expr = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_idx long, vec array<double>")
    delta = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "cell_idx long, vec array<double>")
    df = transition.all_correlations(expr, delta, 16)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    got = df.toPandas()
    assert len(got) == 1200 * 1200 and not got.duplicated(["i", "j"]).any()
    r = np.zeros((1200, 1200))
    r[got["i"], got["j"]] = got["corr"]
    for i in (0, 7, 40, 500):
        y = x - x[i]
        y, own = y - y.mean(1, keepdims=True), d[i] - d[i].mean()
        size = (y * y).sum(1)
        want = np.where(size <= transition.EPS, 1.0, (y @ own) / np.sqrt(np.where(size <= transition.EPS, 1.0, size) * (own @ own)))
        assert np.abs(r[i] - want).max() < 1e-9


def test_all_correlations_are_small_on_disk(spark, tmp_path):
    """equal values stand together, so that the result of 2,000 cells takes less than a double a row."""
    QUERIES["all_correlations"](spark, "/root/testdata/sf0.1").write.parquet(str(tmp_path / "out"))
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 7 * 2000 * 2000
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert len(got) == 2000 * 2000 and not got.duplicated(["i", "j"]).any()
    vec = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.maximum(np.stack(vec["embedding"]).astype(float), 0.0)
    d = np.zeros_like(x)
    d[:, 12], d[:, 20] = -x[:, 12], 0.1
    at = {c: k for k, c in enumerate(vec["vec_id"])}
    i, j = got["i"].map(at).to_numpy(), got["j"].map(at).to_numpy()
    r = np.zeros((2000, 2000))
    r[i, j] = got["corr"]
    for k in range(0, 2000, 50):
        y, own = x - x[k], np.round(d[k], 3) - np.round(d[k], 3).mean()
        y -= y.mean(1, keepdims=True)
        size = (y * y).sum(1) * (own @ own)
        want = np.where(size <= transition.EPS, 1.0, (y @ own) / np.sqrt(np.where(size <= transition.EPS, 1.0, size)))
        assert np.abs(r[k] - want).max() < 5.1e-7


def test_all_correlations_round_as_spark(spark, monkeypatch):
    """every pair once, rounded as Spark rounds, whatever fits a sort, for keys of any type and cells without delta."""
    half = np.arange(0, 40) * 1e-6 + 5e-7
    r = np.concatenate([half, np.nextafter(half, 0), np.nextafter(half, 1), -half, [0.0, -0.0, -1e-9, 1.0, -1.0, 0.3000005, np.nan], np.random.default_rng(4).uniform(-1, 1, 5000)])
    want = [row["r"] for row in spark.createDataFrame([(k, float(v)) for k, v in enumerate(r)], "k long, r double").select("k", F.round("r", 6).alias("r")).orderBy("k").collect()]
    (one, two, got), = transition._sorted_pairs([(0, r[None])], 1, len(r), 6)
    assert not one.any() and sorted(two) == list(range(len(r))) and np.isnan(got[-1]) and (np.diff(got[:-1]) >= 0).all()
    assert np.array_equal(got[np.argsort(two)], np.array(want), equal_nan=True)

    rng = np.random.default_rng(8)
    x, d = rng.normal(size=(300, 16)), rng.normal(size=(300, 16))
    x[7] = x[8]
    expr = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(x)], "cell_idx string, vec array<double>")
    delta = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(d) if i % 5], "cell_idx string, vec array<double>")
    plain = {(r["i"], r["j"]): r["corr"] for r in transition.all_correlations(expr, delta, 16).withColumn("corr", F.round("corr", 6)).collect()}
    monkeypatch.setattr(transition, "SORTED", 700)
    monkeypatch.setattr(transition, "GROUP", 50)
    monkeypatch.setattr(transition, "BATCH", 90)
    rows = transition.all_correlations(expr, delta, 4, digits=6).collect()
    assert len(rows) == len(plain) == 240 * 300 and {(r["i"], r["j"]): r["corr"] for r in rows} == pytest.approx(plain, abs=1.1e-6)
    assert transition.all_correlations(expr.limit(0), delta, digits=6).count() == 0


@pytest.mark.parametrize("radii", [[100.0] * 3, [50.0, 75.0, 300.0]])
def test_kernel_by_boxes_is_exact(spark, monkeypatch, radii):
    """above PAIRS the sum takes time in proportion to the cells, and is that of all pairs."""
    n, rng = 700, np.random.default_rng(2)
    x, y = rng.normal(0, 125, n), rng.normal(0, 125, n)
    x[0], y[0] = 900.0, -700.0
    v = np.where(rng.uniform(size=(n, 3)) < 0.4, 0.0, rng.uniform(0, 5, (n, 3)))
    cells = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "cell_idx long, x double, y double")
    values = spark.createDataFrame([(i, g, float(v[i, k])) for i in range(n) for k, g in enumerate("ABC") if v[i, k]], "cell_idx long, gene string, value double")
    monkeypatch.setattr(kernel, "PAIRS", 0)
    monkeypatch.setattr(kernel, "_summed", None)  # not pair by pair
    got = kernel.exact(cells, values, list("ABC"), radii, 2.0, 0.5).toPandas().pivot(index="cell_idx", columns="gene", values="value").to_numpy()
    d2 = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
    want = np.column_stack([np.exp(-d2 / (2 * r * r)) @ np.where(v[:, k] > 0.5, v[:, k], 0.0) for k, r in enumerate(radii)]) * 2.0 / n
    assert got.shape == (n, 3) and np.abs(got - want).max() < 1e-13
    monkeypatch.undo()
    monkeypatch.setattr(kernel, "PAIRS", 0)
    odd = cells.withColumn("x", F.when(F.col("cell_idx") == 5, F.lit(1e9)).otherwise(F.col("x")))  # too many boxes: pairs
    assert kernel.signal_over(odd, radii, n) is None and kernel.exact(odd, values, list("ABC"), radii).where("value >= 0").count() == 3 * n


@pytest.mark.parametrize("name", ["perturb_round1", "perturb_round2", "perturb_scoped", "perturb_summary", "received_multi_radius"])
def test_queries_by_boxes_equal_sql(spark, duck, sf_dir, monkeypatch, name):
    """F3, F5, F6, F7, F8: the way that many cells go, with the tables' values, without a join of coefficients."""
    monkeypatch.setattr(kernel, "PAIRS", 0)
    monkeypatch.setattr(kernel, "_summed", None)
    monkeypatch.setattr(perturb, "splash", None)
    same(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).fetchdf())


def test_many_rounds_by_cell(spark, monkeypatch):
    n, rng = 400, np.random.default_rng(6)
    cells = spark.createDataFrame([(i, float(a), float(b), i % 3) for i, (a, b) in enumerate(rng.uniform(0, 200, (n, 2)))], "cell_idx long, x double, y double, cluster int")
    dense = spark.createDataFrame([(i, g, float(rng.uniform(0, 5))) for i in range(n) for g in "LMRTU"], "cell_idx long, gene string, value double")
    b = spark.createDataFrame([(c, t, k, x, y, 0.3 - 0.2 * c) for c in (0, 1) for t, k, x, y in (("T", "lr", "L", "R"), ("T", "tf", "U", None), ("U", "tfl", "M", "T"), ("U", "tf", "T", None), ("U", "lr", "M", "absent"), ("R", "lr", "none", "T"))], "cluster int, target string, term_type string, a string, b string, beta double")
    wanted = cells.where("cell_idx % 3 = 0").select("cell_idx", F.lit("L").alias("gene"), F.lit(0.0).alias("desired")).union(cells.where("cell_idx = 4").select("cell_idx", F.lit("M"), F.lit(9.0)))

    def run(**k):
        return {(r["cell_idx"], r["gene"]): v for r in perturb.propagate(cells, dense, b, wanted, {"L": 50.0, "M": 30.0}, 6, **k).collect() for v in (r["delta"], r["simulated"])}

    for k in ({}, {"cap": 0.1, "beta_scale": 2.0, "scale": 30.0}):
        want = run(**k)
        with monkeypatch.context() as m:
            m.setattr(kernel, "PAIRS", 0)
            m.setattr(perturb, "splash", None)
            got = run(**k)
        assert got == pytest.approx(want, abs=1e-9) and len(got) == 5 * n


def test_moran_p_deals_without_moving_links(spark, monkeypatch):
    """nothing is joined a deal, and the joins give the same."""
    n, rng = 300, np.random.default_rng(9)
    ids = [7 * i - 900 for i in range(n)]
    e = spark.createDataFrame([(g, c, float(x)) for g in "ABC" for c, x in zip(ids, np.cumsum(rng.normal(size=n)) if g == "B" else rng.normal(size=n))] + [("flat", c, 1.0) for c in ids], "gene string, cell_idx long, e double")
    edges = spark.createDataFrame([(x, y) for k in (1, 3) for x, y in zip(ids, ids[k:])] + [(ids[1], ids[0])], "i long, j long")
    hashed = [r["h"] for r in spark.createDataFrame([(c,) for c in ids], "c long").select("c", F.xxhash64(F.lit(17), "c").alias("h")).orderBy("c").collect()]
    assert neighbors._hashes(17, np.array(ids)).tolist() == hashed

    def run():
        return {r["gene"]: (r["moran_i"], r["p"]) for r in neighbors.moran_permutations(e, edges, ["A", "B", "C", "flat", "none"], 30).collect()}

    made, cut = [], neighbors.cut
    monkeypatch.setattr(neighbors, "cut", lambda df: made.append(out := cut(df)) or out)
    got = run()
    assert all("perm" not in df.columns for df in made)
    monkeypatch.setattr(neighbors, "HELD_BYTES", 8 * n * 3)  # three genes at a time; the links fit
    monkeypatch.setattr(neighbors, "LINKS", 50)
    again = run()
    assert all(again[g] == pytest.approx(got[g], abs=1e-12) for g in got)
    monkeypatch.setattr(neighbors, "HELD_BYTES", 0)
    want = run()
    assert set(got) == set(want) == {"A", "B", "C", "flat"}
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-12)
