"""The session's questions on the adapted tables."""

import pytest
from pyspark.sql import functions as F

from tissuequery.plans.queries import LIGANDS
from tissuequery.plans.session import Session
from tissuequery.sources import adapters as A


@pytest.fixture(scope="module")
def session(spark, sf_dir):
    few = A.cells(spark, sf_dir).where("cell_idx < 60").persist()
    values = A.expression(spark, sf_dir).where("cell_idx < 60").persist()
    return Session(few, values, A.genes(spark), A.network(spark), A.betas(spark).persist(), dict.fromkeys(LIGANDS, 100.0))


def test_tables(session):
    meta = session.meta()
    assert meta["n_cells"] == 60 and meta["n_genes"] == 64 and meta["umap"] and meta["bounds"][0] < meta["bounds"][1]
    assert session.spatial().count() == session.umap().count() == session.clusters().count() == session.cell_type_codes().count() == 60
    assert [r["gene"] for r in session.find_genes("G1", 2).collect()] == ["G10", "G11"] and session.all_genes().count() == 64
    assert session.gene_expression("G05").count() == 60
    assert {r["label"] for r in session.label_clusters({0: "T"}).collect()} <= {"T"} | {f"Cluster {c}" for c in range(1, 10)}
    assert {r["gene"] for r in session.cluster_mean_expression(["G01", "none"]).collect()} == {"G01", "none"}
    for bad in (lambda: session.gene_expression("none"), lambda: session.coefficient_terms("none"), lambda: session.cluster_mean_expression(["G"] * 201), lambda: session.interactions("median")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(LookupError):
        Session(session.cells.drop("umap_x"), session.expression, session.genes).umap()


def test_coefficients(session):
    terms = [r["term"] for r in session.coefficient_terms("G08").collect()]
    assert terms == sorted(terms) and "G08" in [r["gene"] for r in session.coefficient_genes().collect()]
    own = {r["cluster"]: r["beta"] for r in session.betas.where(f"target = 'G08' AND term_type = 'tf' AND a = '{terms[0]}'").collect()} if "$" not in terms[0] and "#" not in terms[0] else None
    got = session.coefficient_values("G08", terms[0]).join(session.clusters(), "cell_idx").collect()
    assert len(got) == 60 and (own is None or all(r["beta"] == own[r["cluster"]] for r in got))
    assert session.top_coefficients("G08", [0, 1, 1], 3).count() == 3
    rows, total, cut = session.interactions(" Mean ", {"clusters": [1, 2]}, 2)
    sizes = [abs(r["beta"]) for r in rows.collect()]
    assert len(sizes) == total and not cut and sizes == sorted(sizes, reverse=True) and rows.select("target").distinct().count() <= 2
    assert session.cell_context(7, 3).select("j").distinct().count() <= 3 and session.cell_context(7, radius=-1.0).count() == 0


def test_scopes(session):
    assert session.scoped({"indices": [3, 1, 3]}).count() == 2
    assert session.scoped({"cell_type": " type_1 "}).count() == session.scoped({"category": 1}).count()
    for bad in ({"indices": [60]}, {"cell_type": " "}, {"clusters": [99]}, {"category": 65535}, {"place": 1}):
        with pytest.raises(ValueError):
            session.scoped(bad)


def test_perturbation(session):
    delta = session.perturb_preview("G01", 0.0, "G01", 1, {"indices": [1, 2]}).where("delta != 0")
    assert {r["cell_idx"] for r in delta.collect()} <= {1, 2}
    field = session.umap_field("G12", 0.0, quick=True, neighbors_=5)
    assert field.agg(F.max(F.greatest(F.abs("u"), F.abs("v")))).first()[0] == pytest.approx(0.85)
