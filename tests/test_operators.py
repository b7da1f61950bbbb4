"""Hand-computed values of the operators."""

import math

import numpy as np
import pytest

from tissuequery.functions import codec
from tissuequery.operators import betas as B
from tissuequery.operators import kernel, lasso, neighbors, perturb, summaries, transition
from pyspark.sql import functions as F


def cells(spark, points, clusters=None):
    return spark.createDataFrame([(i, f"c{i}", float(x), float(y), (clusters or [0] * len(points))[i], "a", "k") for i, (x, y) in enumerate(points)], "cell_idx long, cell_id string, x double, y double, cluster int, cell_type string, condition string")


def values(spark, gene, vs):
    return spark.createDataFrame([(i, gene, float(v)) for i, v in enumerate(vs)], "cell_idx long, gene string, value double")


def as_list(df, col="value"):
    return [r[col] for r in df.orderBy("cell_idx").collect()]


@pytest.mark.parametrize("points, radius, lig, scale, want", [
    ([(0, 0)], 1.0, [1], 1.0, [1.0]),
    ([(0, 0)], 1.0, [1], 2.5, [2.5]),
    ([(0, 0), (2, 0)], 1.0, [0, 1], 1.0, [math.exp(-2) / 2, 0.5]),
    ([(0, 0), (1.5, 0)], 2.0, [0, 1], 1.0, [math.exp(-2.25 / 8) / 2, 0.5]),
    ([(0, 0), (100, 0)], 0.001, [5, 10], 1.0, [2.5, 5.0]),
])
def test_kernel(spark, points, radius, lig, scale, want):
    got = as_list(kernel.exact(cells(spark, points), values(spark, "L", lig), ["L"], [radius], scale))
    assert got == pytest.approx(want, abs=1e-12)


def test_grid_is_near_exact(spark):
    rng = np.random.default_rng(1)
    pts = rng.uniform(0, 500, (200, 2)).tolist()
    c, v = cells(spark, pts), values(spark, "L", rng.uniform(0, 5, 200))
    a, b = as_list(kernel.on_grid(c, v, ["L"], 100.0, 0.5)), as_list(kernel.exact(c, v, ["L"], [100.0]))
    assert a != b and max(abs(x - y) for x, y in zip(a, b)) < 0.5


def test_radius_counts(spark):
    got = {(r["i"], r["j"]) for r in neighbors.within_radius(cells(spark, [(0, 0), (1, 0), (2.01, 0), (float("nan"), 0)]), 1.0).collect()}
    assert got == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)}


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(50, 0.1, (40, 2)), [[0.0, 0.0], [0.0, 0.0]]])
    got = {}
    for r in neighbors.nearest(cells(spark, pts.tolist()), 5).collect():
        got.setdefault(r["i"], {})[r["rank"]] = r["j"]
    for i in range(len(pts)):
        d = ((pts - pts[i]) ** 2).sum(1)
        want = sorted((x for x in range(len(pts)) if x != i), key=lambda x: (d[x], x))[:5]
        assert [got[i][k] for k in range(1, 6)] == want
    assert neighbors.nearest(cells(spark, [(0, 0), (1, 0), (2, 0)]), 100).count() == 6


FRAME = [(0, "target1", "tf", "A", None, 0.5), (0, "target1", "tf", "B", None, -0.3), (0, "target1", "lr", "C", "D", 0.2), (0, "target1", "tfl", "C", "A", 0.1),
         (1, "target1", "tf", "A", None, 0.8), (1, "target1", "tf", "B", None, 0.1), (1, "target1", "lr", "C", "D", -0.1), (1, "target1", "tfl", "C", "A", 0.4)]
BETA = "cluster int, target string, term_type string, a string, b string, beta double"


def test_splash(spark):
    c = cells(spark, [(0, 0), (1, 0)], [0, 1])
    x = {"A": [1.5, 0.0], "B": [0.8, 1.2], "C": [3.0, 1.0], "D": [2.0, 0.0]}
    e = spark.createDataFrame([(i, g, v) for g, vs in x.items() for i, v in enumerate(vs)], "cell_idx long, gene string, value double")
    b = spark.createDataFrame(FRAME, BETA)

    def run(**k):
        return {(r["cell_idx"], r["gene"]): r["deriv"] for r in B.splash(c, b, e, values(spark, "C", [3.0, 1.0]), values(spark, "C", [2.0, 0.5]), **k).collect()}

    got = run()
    want = {(0, "A"): 0.7, (1, "A"): 1.0, (0, "B"): -0.3, (1, "B"): 0.1, (0, "C"): 0.55, (1, "C"): 0.0, (0, "D"): 0.6, (1, "D"): 0.0}
    assert got == pytest.approx(want)
    got = run(scale=2.0, cap=0.5)
    assert [got[0, "A"], got[1, "A"], got[0, "B"], got[1, "B"]] == pytest.approx([0.5, 0.5, -0.3, 0.1])


def wired(spark, n=25):
    side = math.ceil(math.sqrt(n))
    c = cells(spark, [(10.0 * (i % side), 10.0 * (i // side)) for i in range(n)])
    dense = spark.createDataFrame([(i, g, 1.0) for i in range(n) for g in "ABCDEZ"], "cell_idx long, gene string, value double")
    b = spark.createDataFrame([(0, "D", "tf", "A", None, 0.5), (0, "D", "lr", "B", "C", 0.3), (0, "E", "tf", "A", None, 0.4), (0, "E", "tf", "D", None, 0.6)], BETA)
    return c, dense, b


@pytest.mark.parametrize("rounds, d, e", [(1, -0.5, -0.4), (2, -0.5, -0.7), (4, -0.5, -0.7)])
def test_knockout(spark, rounds, d, e):
    c, dense, b = wired(spark)
    wanted = c.select("cell_idx", F.lit("A").alias("gene"), F.lit(0.0).alias("desired"))
    got = {(r["cell_idx"], r["gene"]): (r["delta"], r["simulated"]) for r in perturb.propagate(c, dense, b, wanted, {"B": 50.0}, rounds).collect()}
    for i in range(25):
        assert got[i, "A"][1] == 0
        assert got[i, "D"][0] == pytest.approx(d) and got[i, "E"][0] == pytest.approx(e)
        assert abs(got[i, "Z"][0]) < 1e-9 and got[i, "E"][1] >= 0


def test_two_cells(spark):
    c = cells(spark, [(0, 0), (1, 0)])
    x = {"TF1": [1, 1], "LIG": [10, 0], "REC": [1, 1], "TARGET": [1, 1]}
    dense = spark.createDataFrame([(i, g, float(v)) for g, vs in x.items() for i, v in enumerate(vs)], "cell_idx long, gene string, value double")
    b = spark.createDataFrame([(0, "TARGET", "tf", "TF1", None, 0.1), (0, "TARGET", "lr", "LIG", "REC", 0.05)], BETA)
    wanted = spark.createDataFrame([(0, "TF1", 0.0), (0, "LIG", 0.0)], "cell_idx long, gene string, desired double")
    got = {r["cell_idx"]: r["delta"] for r in perturb.propagate(c, dense, b, wanted, {"LIG": 1.0}, 1).where("gene = 'TARGET'").collect()}
    assert got[0] == pytest.approx(-0.35) and got[1] == pytest.approx(-0.1516327, abs=1e-6)


def test_lasso_recovers_and_shrinks():
    n = 50
    x = np.array([(i / n, (n - i) / n) for i in range(n)])
    y = 2 * x[:, 0] + 3 * x[:, 1]
    got = lasso.fit(x, y, np.array([0, 1]), 1e-9, 1e-9, 5000, 1e-10, intercept=False)
    assert got["coef"] == pytest.approx([2, 3], abs=0.2)
    assert np.abs(lasso.fit(x, y, np.array([0, 1]), 100, 100)["coef"]).max() < 1e-3
    x = np.array([[((7 * i + 13 * j) % 97) / 97 for j in range(5)] for i in range(100)])
    y = 2 * x[:, 0] - 1.5 * x[:, 1]
    got = lasso.fit(x, y, np.zeros(5, int), 1e-3, 1e-3, 20000, 1e-12)
    # optimality: the residual's pull on each active coefficient equals the penalties' slope
    w, r = got["coef"], y - got["intercept"] - x @ got["coef"]
    pull = (x - x.mean(0)).T @ r / 100
    reg = 1e-3 * math.sqrt(5)
    slope = 1e-3 * np.sign(w) + reg * w / np.linalg.norm(w)
    assert np.abs(pull - slope)[np.abs(w) > 1e-8].max() < 1e-5


def test_transition_rules(spark):
    e = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [2.0, 4.0, 6.0]), (2, [0.0, 0.0, 0.0])], "cell_idx long, vec array<double>")
    d = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 1.0])], "cell_idx long, vec array<double>")
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (2, 0)], "i long, j long")
    got = {(r["i"], r["j"]): r["corr"] for r in transition.correlations(edges, e, d).collect()}
    assert got == pytest.approx({(0, 1): 1.0, (0, 2): -1.0, (1, 0): 1.0, (2, 0): 1.0})
    assert transition.axis(0, 10, 5)[0] >= 4
    p = transition.probabilities(edges.join(spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.1), (1, 0, 1.0), (2, 0, 1.0)], "i long, j long, corr double"), ["i", "j"]), 0.05, False)
    assert p.groupBy("i").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-12").count() == 0


@pytest.mark.parametrize("label, want", [("batch A / drug+B", "batch_A_drug_B"), ("   ", "group"), ("...", "group"), ("A-B", "A-B")])
def test_condition_names(spark, label, want):
    assert spark.createDataFrame([(label,)], "l string").select(codec.sanitized_condition(F.col("l"))).first()[0] == want


def test_condition_clashes(spark):
    c = spark.createDataFrame([(0, "A B"), (1, "A/B"), (2, "A_B"), (3, "A-B"), (4, None)], "cell_idx long, condition string")
    got = {r["condition"]: r["directory"] for r in summaries.condition_groups(c).collect()}
    assert got == {"A B": "A_B", "A/B": "A_B_2", "A_B": "A_B_3", "A-B": "A-B", "_na": "_na"} or got["_na"] == "na"


def test_moran_constant_is_zero(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)], "i long, j long")
    e = spark.createDataFrame([("g", i, 1.0) for i in range(6)], "gene string, cell_idx long, e double")
    assert neighbors.morans_i(e, neighbors.symmetric(ring)).first()["moran_i"] == 0
