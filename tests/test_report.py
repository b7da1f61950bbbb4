"""Report pages, written perturbations, progress and display rules."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tissuequery.functions import display
from tissuequery.plans import report
from tissuequery.plans.session import Session
from tissuequery.sources import adapters as A


def test_display(spark):
    assert [display.duration(s) for s in (0.2, 59, 60, 61, 3600, 3720, -1, float("inf"))] == ["1s", "59s", "1m", "1m 1s", "1h", "1h 2m", "—", "—"]
    assert [display.percent(p) for p in (0, 4, 5, 996, 2000)] == [0, 0, 1, 100, 100]
    row = spark.createDataFrame([(1234567, "beta_A$B", "C#D")], "n long, a string, b string").select(display.thousands(F.col("n")), display.interaction_label(F.col("a")), display.interaction_label(F.col("b"))).first()
    assert tuple(row) == ("1,234,567", "A – B", "C → D")
    v = spark.createDataFrame([(x,) for x in (-3.0, 1.0, 2.0, float("nan"), float("inf"))], "value double")
    assert display.value_range(v) == (-3.0, 2.0) and display.value_range(v.limit(0)) == (0.0, 1.0)
    assert display.symmetric_range(v) == (-2.0, 2.0) and display.symmetric_range(v.limit(0)) == (-1.0, 1.0)


def test_rollups_and_page(spark, sf_dir):
    s = spark.createDataFrame([("b<", 0, 0.5, True), ("b<", 1, 0.3, False), ("Ab", 0, 0.9, True)], "gene string, cluster int, r2 double, converged boolean")
    both = report.all_rollups({"": s, "k": s.where("gene = 'Ab'")})
    assert [r["gene"] for r in both.collect()] == ["Ab", "b<", "k::Ab"]
    assert [r["gene"] for r in report.sorted_rollups(both, " AB", "mean_r2").collect()] == ["Ab", "k::Ab"]
    assert [r["gene"] for r in report.extremes(both, 1)[1].collect()] == ["b<"]
    few = Session(A.cells(spark, sf_dir).where("cell_idx < 20"), A.expression(spark, sf_dir).where("cell_idx < 20"), A.genes(spark))
    page = report.summary_page(few, both, {"lasso": {"l1": 1, "l2": 2}}, {"lasso": {"l1": 1}}, "a & b")
    assert "a &amp; b" in page and "lasso.l2" in page and "lasso.l1" not in page
    assert len(json.loads(re.search(r'id="genes">(.*)</script>', page)[1])) == 3
    wide = spark.createDataFrame([("G", "lr", "a", "b", float(i)) for i in range(50)], "target string, term_type string, a string, b string, beta double")
    assert report.bar_chart(wide, "lr", 99).count() == 40 and report.bar_chart(wide, "lr", 1).count() == 5


def test_files(spark, sf_dir, tmp_path):
    (tmp_path / "conditions" / "x").mkdir(parents=True)
    for name in ("a_betadata.feather", "conditions/x/b_betadata.feather", "note.txt"):
        (tmp_path / name).write_bytes(b"123")
    assert tuple(report.output_metrics(spark, str(tmp_path)).first()) == (2, 6, 2)
    assert report.read_manifest(str(tmp_path / "none"), {"a": {"x": 1}}) == {"a": {"x": 1}}
    (tmp_path / "m.json").write_text('{"a": {"y": 2}, "b": 3}')
    assert report.read_manifest(str(tmp_path / "m.json"), {"a": {"x": 1}}) == {"a": {"x": 1, "y": 2}, "b": 3}
    few = Session(A.cells(spark, sf_dir).where("cell_idx < 20").persist(), A.expression(spark, sf_dir).where("cell_idx < 20").persist(), A.genes(spark), betas=A.betas(spark), radii={"G01": 100.0})
    done = report.write_perturbations(few, {"G01": 0.0}, str(tmp_path / "out"), 1, {"indices": [1]}).first()
    own = spark.read.parquet(done["folder"])
    assert own.count() == 20 * 64 and done["max_abs"] == pytest.approx(own.agg(F.max(F.abs("delta"))).first()[0])


def test_progress():
    assert report.mean_recent_seconds([100.0] + [2.0] * 64) == 2.0 and report.mean_recent_seconds([]) is None
    assert report.genes_per_second(10, 5.0, []) == 2.0 and report.genes_per_second(0, 5.0, [4.0], 8) == 2.0 and report.genes_per_second(0, 5.0, []) is None
    assert report.seconds_left(10, 2.0) == 5.0 and report.seconds_left(10, None) is None
