"""Matrices in every layout, dataset files, and the solver's small parts."""

import numpy as np
import pandas as pd
import pytest

from tissuequery.operators import lasso
from tissuequery.sources import annotated as D

DENSE = np.array([[1.0, 0.0, 2.0], [0.0, 0.0, 0.0], [0.0, 3.0, 4.0]])
CSR = {"data": np.array([1.0, 2.0, 3.0, 1.0, 3.0]), "indices": np.array([0, 2, 1, 2, 2]), "indptr": np.array([0, 2, 2, 5]), "encoding-type": "csr_matrix"}
CSC = {"data": np.array([1.0, 3.0, 2.0, 4.0]), "indices": np.array([0, 2, 0, 2]), "indptr": np.array([0, 1, 2, 4]), "encoding-type": "csc_matrix"}
WANT = {(0, 0, 1.0), (0, 2, 2.0), (2, 1, 3.0), (2, 2, 4.0)}


@pytest.mark.parametrize("node", [DENSE, CSR, CSC])
def test_layouts(spark, node):
    got = {t for s in (0, 2) for t in zip(*(v.tolist() for v in D.triplets(node, s, min(s + 2, 3))))}
    assert got == WANT and D.major_size(node) == 3
    root = {"X": node, "layers": {}}
    rows = D.expression(spark, "a", "raw", ["a", "b", "c"], block=2, opener=lambda path: root).collect()
    assert {(r["cell_idx"], "abc".index(r["gene"]), r["value"]) for r in rows} == WANT
    with pytest.raises(KeyError):
        D.layer_of(root, "raw", strict=True)
    with pytest.raises(TypeError):
        D.triplets({"a": DENSE}, 0, 1)


def test_parts():
    root = {"obsm": {"spatial": np.zeros((3, 1)), "X_spatial": np.ones((3, 3), np.float32), "umap": np.zeros((2, 2))}}
    assert D.spatial(root)[0] == "X_spatial" and D.coordinates(root, D.UMAP_KEYS, 3) is None
    with pytest.raises(KeyError):
        D.spatial({})
    assert D.type_column(["x", "Cell_Type"]) == "Cell_Type" and D.type_column(["celltype", "cell_types"]) == "cell_types" and D.type_column([]) is None
    v = pd.Series([0.5, 1.7, None, -1.5])
    assert D.cluster_ids(v).tolist() == [0, 1, 0, -1] and D.cluster_ids(v, True).tolist() == [1, 2, 0, -2]


def test_dataset_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0.0, 1.0, 0), (1, 2.0, 3.0, 1)], "cell_idx long, x double, y double, cluster int")
    genes = spark.createDataFrame([("a",)], "gene string")
    D.write_dataset(str(tmp_path / "d"), cells, spark.createDataFrame([(0, "a", 1.0), (1, "a", 0.0)], "cell_idx long, gene string, value double"), genes, parameters={"radius": 5})
    got = D.read_dataset(spark, str(tmp_path / "d"))
    assert got["expression"].count() == 1 and got["parameters"] == {"radius": 5}
    D.check_training_inputs(cells, genes, genes)
    for bad in (lambda: D.check_training_inputs(cells, genes, genes, "none"), lambda: D.check_training_inputs(cells.limit(0), genes, genes), lambda: D.check_training_inputs(cells.selectExpr("'x' as cluster"), genes, genes)):
        with pytest.raises(ValueError):
            bad()
    D.write_dataset(str(tmp_path / "e"), cells, spark.createDataFrame([(5, "a", 1.0)], "cell_idx long, gene string, value double"), genes)
    with pytest.raises(ValueError):
        D.read_dataset(spark, str(tmp_path / "e"))


def test_solver_parts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) * np.array([5.0, 1, 1, 1])
    assert lasso.largest_singular_value(x) == pytest.approx(np.linalg.norm(x, 2), rel=0.02)
    assert lasso.largest_singular_value(x, 0.5) == pytest.approx(np.linalg.norm(x, 2), rel=0.2)
    assert [len(lasso.chosen_rows(100, s, rng)) for s in (None, 0.2, 7, "sqrt")] == [100, 20, 7, 10]
    coef = np.array([1.0, 0.0, -2.0, 0.0])
    assert lasso.active(coef).tolist() == [True, False, True, False] and lasso.active_groups(coef, np.array([0, 0, 1, 2])) == {0, 1} and lasso.transformed(x, coef).shape == (200, 2)
    clusters, y = np.arange(200) % 2, x @ coef + 3.0 * (np.arange(200) % 2)
    fits = lasso.fit_clusters(x, y, clusters, np.zeros(4, int), l1=1e-9, group_reg=1e-9, iterations=3000, tolerance=1e-10)
    assert np.allclose(lasso.predict_clusters(x, clusters, fits), y, atol=1e-3)
    with pytest.raises(KeyError):
        lasso.predict_clusters(x, clusters + 5, fits)
    with pytest.raises(ValueError):
        lasso.predict(x[:, :2], fits[0])
