"""Training runs: fits from summed cross products, priors, files, resuming, logs, sessions of a run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuequery.functions import display
from tissuequery.operators import betas as B
from tissuequery.operators import lasso, network, training
from tissuequery.plans import train
from tissuequery.plans.queries import _design
from tissuequery.plans.session import Session
from tissuequery.sources import adapters as A
from tissuequery.sources import files
from tissuequery.sources.config import Config

SETTINGS = Config.parse("[lasso]\nl1_reg = 1e-3\ngroup_reg = 1e-3\nn_iter = 300\n[training]\nscore_threshold = 0.3\n[spatial]\nradius = 5.0\n[perturbation]\nn_propagation = 2\n")


def test_settings_in_the_format():
    assert (SETTINGS.lasso.l1, SETTINGS.lasso.iterations, SETTINGS.lasso.least_r2, SETTINGS.kernel.radius, SETTINGS.perturbation.rounds) == (1e-3, 300, 0.3, 5.0, 2)
    assert Config.parse("[lasso]\nl1 = 1.0\nl1_reg = 2.0").lasso.l1 == 1.0


def test_fit_from_cross_products():
    rng = np.random.default_rng(1)
    x, groups = rng.normal(3, 1, (90, 6)), np.array([0, 0, 1, 1, 2, -1])
    y = x @ [1, 0, 0.5, 0, 0, 0.2] + 4 + rng.normal(0, 0.1, 90)
    parts = [lasso.moments(x[a:b], y[a:b]) for a, b in ((0, 0), (0, 1), (1, 40), (40, 90))]
    total = parts[0]
    for p in parts[1:]:
        total = lasso.merged(total, p)
    z = np.column_stack([x, y])
    assert total[0] == 90 and np.allclose(total[1], z.mean(0)) and np.allclose(total[2], (z - z.mean(0)).T @ (z - z.mean(0)))
    options = {"l1": 0.01, "group_reg": 0.01, "iterations": 20000, "tolerance": 1e-13}
    got = lasso.fit(x, y, groups, **options)
    w, r = got["coef"], y - x @ got["coef"] - got["intercept"]
    assert got["mse"] == pytest.approx((r @ r) / 90) and got["r2"] == pytest.approx(1 - (r @ r) / ((y - y.mean()) ** 2).sum())
    regs = lasso.group_strengths(groups, 0.01)

    def cost(v):
        e = (y - y.mean()) - (x - x.mean(0)) @ v
        return e @ e / 180 + lasso.penalty(v, 0.01, regs, groups)

    assert all(cost(w) <= cost(w + rng.normal(0, s, 6)) + 1e-12 for s in (1e-4, 1e-3, 1e-2) for _ in range(50))
    assert np.allclose(lasso.fit(x, y, groups, bound="frobenius", **options)["coef"], w, atol=1e-6)
    assert np.allclose(lasso.fit(x, y, groups, group_regs=regs, **options)["coef"], w, atol=1e-9)
    assert lasso.fit(x, y, groups, l1=0.0, group_regs={1: 100.0})["coef"][2:4].tolist() == [0.0, 0.0]
    assert lasso.checked_groups(None, 3).tolist() == [0, 1, 2]
    with pytest.raises(ValueError, match="2 groups for 6"):
        lasso.fit(x, y, np.array([0, 1]))


def test_summed_fits_equal_fits_of_designs(spark, sf_dir):
    """The same fits as from a design in one task, whatever the cells' partitions and order."""
    terms = A.design_terms(spark).select("target", "term_type", "a", "b")
    index = {f"G{i:02d}": i for i in range(A.GENES)}
    ligands = [f"G{i:02d}" for i in range(A.LIGANDS)]
    batch = [s for _, s in sorted(training.specs(terms.collect(), index, ligands).items())]
    table = training.cell_table(A.cells(spark, sf_dir), A.expression(spark, sf_dir), A.genes(spark), ligands, 100.0)
    options = {"l1": 1e-3, "group_reg": 1e-3}
    want = {(r["target"], r["cluster"]): r for r in lasso.fit_groups(_design(spark, sf_dir), **options).collect()}
    for parts in (1, 30):
        got = training.fitted(training.summed(table.repartition(parts), batch), batch, **options).collect()
        assert {(r["target"], r["cluster"]) for r in got} == set(want)
        for r in got:
            w = want[r["target"], r["cluster"]]
            assert r["n_cells"] == w["n_cells"] and np.allclose(r["coef"], w["coef"], atol=2e-4) and r["r2"] == pytest.approx(w["r2"], abs=1e-4)


def small(spark):
    """Target T follows factor A, in cluster 1 factor B; U follows nothing; V has no terms."""
    rng = np.random.default_rng(3)
    n = 120
    cells = spark.createDataFrame([(i, f"c{i}", float(i % 11), float(i // 11), i % 2, "a" if i % 2 else "b") for i in range(n)], "cell_idx long, cell_id string, x double, y double, cluster int, cell_type string")
    rows = []
    for i in range(n):
        v = {g: float(rng.uniform(0, 2)) for g in "ABLRU"}
        v["T"] = 2 * v["B"] if i % 2 else 2 * v["A"]
        rows += [(i, g, x) for g, x in v.items()]
    expression = spark.createDataFrame(rows, "cell_idx long, gene string, value double")
    genes = spark.createDataFrame(list(enumerate("ABLRTUV")), "gene_idx int, gene string")
    edges = spark.createDataFrame([("A", "T", "grn", 1.0, 0), ("B", "T", "grn", 1.0, 1), ("L", "U", "grn", 1.0, 2), ("A", "gone", "grn", 1.0, 3)], "source string, target string, edge_type string, weight double, edge_order long")
    return cells, expression, genes, edges


def test_a_run_writes_resumes_and_marks(spark, tmp_path):
    cells, expression, genes, edges = small(spark)
    run = train.Run(cells, expression, genes, edges, SETTINGS)
    folder = str(tmp_path / "run")
    some = genes.where("gene IN ('T', 'U')")
    got = {r["gene"]: r["status"] for r in train.train(run, folder, some).collect()}
    assert got == {"T": "done", "U": "orphan"}  # U's fits fall under the gate
    betas, errors = files.read_coefficients(spark, folder)
    b = {(r["row_id"], r["term"]): r["beta"] for r in betas.where("target = 'T'").collect()}
    assert b["0", "beta_A"] == pytest.approx(2, abs=0.05) and b["1", "beta_B"] == pytest.approx(2, abs=0.05) and abs(b["0", "beta_B"]) < 0.05 and errors.isEmpty()
    logs = files.read_training_logs(spark, folder).collect()
    assert [(r["gene"], r["cluster"], r["n_cells"], r["n_modulators"]) for r in logs] == [("T", 0, 60, 2), ("T", 1, 60, 2), ("U", 0, 60, 1), ("U", 1, 60, 1)]
    assert logs[0]["r2"] > 0.9 and logs[2]["r2"] == 0.0
    before = (tmp_path / "run" / "T_betadata.feather").stat().st_mtime_ns
    got = {r["gene"]: r["status"] for r in train.train(run, folder).collect()}
    assert got == {g: "done" if g == "T" else "orphan" for g in "ABLRTUV"} and (tmp_path / "run" / "T_betadata.feather").stat().st_mtime_ns == before
    assert train.pending(spark, folder, genes).isEmpty() and not list((tmp_path / "run").glob("*.part"))
    session = Session.from_run(folder, cells, expression, genes, edges, SETTINGS)
    assert session.radii == {} and session._of("T").count() == betas.where("target = 'T'").count()
    with pytest.raises(ValueError, match="cluster has no coefficients"):
        Session.from_run(folder, cells.withColumn("cluster", F.lit(7)), expression, genes)
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no coefficients"):
        Session.from_run(str(tmp_path / "none"), cells, expression, genes)


def test_priors_choose_and_mask(spark):
    cells, expression, genes, edges = small(spark)
    priors = spark.createDataFrame([("A", "T", "a"), ("L", "T", "c")], "source string, target string, cell_type string")
    types = spark.createDataFrame([(0, "b"), (1, "a")], "cluster int, cell_type string")
    run = train.Run(cells, expression, genes, edges, SETTINGS, priors, types)
    t = genes.where("gene IN ('T', 'U')")
    assert sorted((r["target"], r["a"]) for r in run.terms(t).collect()) == [("T", "A"), ("T", "L"), ("U", "L")]
    fits = {(r["target"], r["cluster"]): dict(zip(r["terms"], r["coef"])) for r in run.all_fits(t).collect()}
    assert fits["T", 0]["beta_A"] == pytest.approx(2, abs=0.05)  # type b has no list, so nothing is masked
    assert fits["T", 1]["beta_L"] == 0.0  # type a's list has A alone
    pairs = spark.createDataFrame([("T", "tfl", "L", "A"), ("T", "tfl", "L", "B"), ("T", "lr", "L", "R"), ("U", "tfl", "L", "B")], "target string, term_type string, a string, b string")
    assert sorted((r["target"], r["term_type"], r["a"], r["b"]) for r in network.with_prior_factors(pairs, priors).where("term_type != 'tf'").collect()) == [("T", "lr", "L", "R"), ("T", "tfl", "L", "A"), ("U", "tfl", "L", "B")]


def test_empty_runs(spark, tmp_path):
    cells, expression, genes, edges = small(spark)
    run = train.Run(cells.limit(0), expression.limit(0), genes, edges, SETTINGS)
    assert run.all_fits(genes).isEmpty() and training.coefficients(run.all_fits(genes)).isEmpty()
    assert {r["status"] for r in train.train(run, str(tmp_path / "r")).collect()} == {"orphan"}


def test_batches_are_bounded(monkeypatch):
    def spec(y, genes):
        return {"target": str(y), "y": y, "gene": np.array(genes), "ligand": np.full(len(genes), -1)}

    specs = {str(y): spec(y, [y + 10, y + 11]) for y in range(5)}  # two targets have five distinct columns
    monkeypatch.setattr(training, "BATCH_BYTES", 3 * 5**2 * 8)
    assert [[s["target"] for s in b] for b in training.batches(specs, 3)] == [["0", "1"], ["2", "3"], ["4"]]


def test_logs_of_the_format(spark, tmp_path):
    rows = [{"cluster": 2, "n_cells": 10, "n_modulators": 3, "lasso_r2": 0.25, "lasso_mse": 0.5, "iterations": 7, "converged": True}]
    text = files.write_training_log("Gene1", 2, rows, {2: [0.5, 0.4]}, {"use_cnn": True, "mean_target_expression": None}, producer="other_training_log")
    assert text.splitlines()[0] == "format\tother_training_log\tv1" and "2\t10\t3\t0.250000\t0.500000\t7\ttrue\t2\t0.500000\t0.400000" in text and "gate_mean_target_expression\tNA" in text
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "b.log").write_text(text.replace("0.250000", "x"))
    (tmp_path / "c.log").write_text("format\tother\tv1\n")
    (tmp_path / "d.log").write_text(files.write_training_log("gene0", 0, rows))
    got = files.read_training_logs(spark, str(tmp_path)).collect()
    assert [(r["gene"], r["epochs_ran"], r["mse_last"], r["seed_only"]) for r in got] == [("gene0", 0, None, True), ("Gene1", 2, 0.4, False)]
    assert got[1]["gate"] == {"gate_use_cnn": "true", "gate_mean_target_expression": "NA"} and got[0]["gate"] is None


def test_views_and_means(spark):
    assert display.view(100, 50, (0.0, 10.0, 0.0, 10.0)) == pytest.approx((5.0, 5.0, np.log2(50 / 11.2)))
    assert display.view(8, 8, (1.0, 1.0, 1.0, 1.0))[2] == pytest.approx(3.0)
    assert (display.mean_shown(None), display.mean_shown(1.5)) == ("—", "1.5000")
    one = spark.createDataFrame([(float("nan"),), (None,), (0.5,)], "v double")
    got = [r[0] for r in one.select(display.rgb(F.col("v"), F.lit(1.0), F.lit(1.0))).collect()]
    assert got == [[128, 128, 128], [128, 128, 128], [35, 144, 140]]
    assert spark.range(1).select(display.category_rgb(F.col("id"), 0)).first()[0] == [100, 100, 110]


def test_derivatives_without_a_broadcast_and_of_known_ligands(spark, sf_dir, monkeypatch):
    cells, e = A.cells(spark, sf_dir), A.expression(spark, sf_dir)
    received = e.where("gene < 'G08'")

    def slopes(**k):
        return {tuple(r)[:3]: r["deriv"] for r in B.splash(cells, A.betas(spark), e, received, received, **k).collect()}

    want = slopes()
    monkeypatch.setattr(B, "BROADCAST_ROWS", 10)
    assert slopes() == pytest.approx(want, abs=1e-12)
    one = spark.createDataFrame([(0, "T", "lr", "L", "R", 1.0), (0, "T", "lr", "M", "R", 1.0), (0, "T", "tf", "F", None, 1.0)], "cluster int, target string, term_type string, a string, b string, beta double")
    c = spark.createDataFrame([(0, 0)], "cell_idx long, cluster int")
    v = spark.createDataFrame([(0, "R", 2.0)], "cell_idx long, gene string, value double")
    rw = spark.createDataFrame([(0, "L", 3.0)], "cell_idx long, gene string, value double")
    got = {r["gene"]: r["deriv"] for r in B.splash(c, one, v, rw, rw, ligands=["L"]).collect()}
    assert got == {"F": 1.0, "L": 2.0, "R": 3.0}
