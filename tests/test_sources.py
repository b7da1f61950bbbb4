"""Files, settings and names."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tissuequery.functions import codec
from tissuequery.sources import config, files


def test_coefficients_round_trip(spark, tmp_path):
    own = pd.DataFrame({"Cluster": ["0", "1"], "beta0": [1.0, 2.0], "beta_A": [0.5, 0.8], "beta_B": [-0.3, 0.1], "beta_C$D": [0.2, -0.1], "beta_C#A": [0.1, None]})
    own.to_feather(tmp_path / "target1_betadata.feather")
    (tmp_path / "bad_betadata.feather").write_bytes(b"nothing")
    betas, errors = files.read_coefficients(spark, str(tmp_path))
    got = {(r["row_id"], r["term"]): (r["target"], r["term_type"], r["a"], r["b"], r["beta"]) for r in betas.collect()}
    assert len(got) == 10 and got["0", "beta_C$D"] == ("target1", "lr", "C", "D", 0.2) and got["1", "beta_C#A"] == ("target1", "tfl", "C", "A", 0.0)
    assert got["1", "beta0"][1:4] == ("intercept", None, None)
    assert [r["path"].endswith("bad_betadata.feather") for r in errors.collect()] == [True]
    out = tmp_path / "again"
    out.mkdir()
    for r in files.coefficient_files(betas).collect():
        (out / r["name"]).write_bytes(r["content"])
    again = files.read_coefficients(spark, str(out))[0]
    assert again.exceptAll(betas).count() == 0 and betas.exceptAll(again).count() == 0
    assert [r["gene"] for r in files.trained_genes(spark, str(tmp_path)).collect()] == ["bad", "target1"]


def test_training_logs(spark, tmp_path):
    rows = [{"cluster": 0, "n_cells": 10, "n_modulators": 3, "lasso_r2": 0.25, "lasso_mse": 0.5, "iterations": 7, "converged": True}, {"cluster": 1, "n_cells": 5, "n_modulators": 3, "lasso_r2": 0.05, "lasso_mse": 0.1, "iterations": 9, "converged": False}]
    (tmp_path / "g.log").write_text(files.write_training_log("Gene1", 2, rows, {0: [0.5, 0.4]}))
    (tmp_path / "other.log").write_text("unrelated\n")
    got = files.read_training_logs(spark, str(tmp_path)).collect()
    assert [(r["gene"], r["cluster"], r["r2"], r["converged"]) for r in got] == [("Gene1", 0, 0.25, True), ("Gene1", 1, 0.05, False)]


def test_settings(tmp_path):
    c = config.Config.parse("[lasso]\nl1 = 0.5\n[kernel]\ngrid_factor = 0.5\nunknown = 1\n")
    assert c.lasso.l1 == 0.5 and c.kernel.grid_factor == 0.5 and c.lasso.iterations == 500
    assert config.Config.parse(c.to_toml()) == c and config.Config.load(str(tmp_path)) == config.Config()
    assert [round(config.Gate(permissiveness=t).p_max, 6) for t in (0, 0.5, 1)] == [0.015, 0.05, 0.085]
    assert [round(config.Gate(permissiveness=t).least_r2(0.1), 6) for t in (0, 0.5, 1)] == [0.14, 0.1, 0.06]
    assert config.Perturbation().for_request(99).rounds == 32
    assert config.write_once(str(tmp_path / "a"), "x") and not config.write_once(str(tmp_path / "a"), "y")
    assert config.default_output_dir("/x/run.h5ad", datetime.date(2024, 1, 2)).endswith("/run_2024-01-02")
    assert config.parse_gene_set("# note\nA, B\n\nC") == {"A", "B", "C"} and config.parse_gene_filter(" , ") is None
    with pytest.raises(FileNotFoundError, match="mouse_network"):
        config.network_file("mouse", [str(tmp_path)])


def test_species_priors_and_bytes(spark):
    def names(*g):
        return spark.createDataFrame([(x,) for x in g], "gene string")

    assert [files.infer_species(names(*g)) for g in (("Actb", "Gapdh"), ("ACTB", "GAPDH"), ("Actb", "Pax6", "ACTB"))] == ["mouse", "human", "mouse"]
    rows = spark.createDataFrame([(" A ", "B", "t", 0), ("A", "B", "t", 1), ("X", "B", "t", 2), ("A", "B", None, 3)], "source string, target string, cell_type string, prior_order long")
    assert [tuple(r) for r in files.read_priors(rows, names("A", "B")).select("source", "target", "cell_type", "prior_order").collect()] == [("A", "B", "t", 0)]
    assert files.packed([1, 2**40], "u4") == b"\x01\0\0\0\xff\xff\xff\xff" and len(files.interleaved([1.0], [2.0])) == 8
    assert files.request_key(["B", "A"], 0.0, 4, {}) == files.request_key(["A", "B"], 0.0, 4, {}) != files.request_key(["A", "B"], 0.0, 4, {"A": ["t"]})


def test_names(spark):
    row = spark.createDataFrame([("a $ b", "/x/G1_betadata.feather", -1.5)], "p string, f string, v double")
    a, b = codec.pair_parts(F.col("p"), "$")
    got = row.select(a, b, codec.gene_of_file(F.col("f")), codec.sanitized_float(F.col("v")), codec.half_up(F.lit(0.0125), 3)).first()
    assert tuple(got) == ("a", "b", "G1", "m1p500000", 0.013)
