"""Command line entry points (in-process, sharing the test session)."""
import os

from hydrolens.__main__ import main


def test_list(capsys):
    assert main(["list"]) == 0
    names = capsys.readouterr().out.split()
    assert "top_high_risk" in names and "stream_hourly_rollup" in names


def test_query_show_and_out(spark, tmp_path, capsys):
    assert main(["query", "overview_kpis", "--sf-dir", "/root/testdata/sf0.001", "--show", "1"]) == 0
    assert "n_records" in capsys.readouterr().out
    out = str(tmp_path / "q")
    assert main(["query", "peak_hours", "--sf-dir", "/root/testdata/sf0.001", "--out", out, "--format", "csv"]) == 0
    assert spark.read.option("header", True).csv(out).count() == 1
    assert main(["query", "nope"]) == 2


def test_enrich_and_train_jobs(spark, tmp_path, monkeypatch):
    # the job's wiring is under test, not boosting: fewer rounds keep the test short
    # (the registry key includes the parameters, so entries never mix)
    from hydrolens.operators import ml as M
    monkeypatch.setattr(M, "GBT_PARAMS", {**M.GBT_PARAMS, "maxIter": 5})
    out = str(tmp_path / "readings")
    assert main(["enrich", "--sf-dir", "/root/testdata/sf0.001", "--out", out]) == 0
    assert spark.read.parquet(out).count() > 0
    tr = str(tmp_path / "train")
    assert main(["train", "--sf-dir", "/root/testdata/sf0.001", "--out", tr]) == 0
    assert os.path.isdir(f"{tr}/models/rf") and os.path.isdir(f"{tr}/models/gbt")
    assert spark.read.parquet(f"{tr}/metrics").count() == 18


def test_dashboard_job(spark, tmp_path, capsys):
    out = str(tmp_path / "dash")
    assert main(["dashboard", "--sf-dir", "/root/testdata/sf0.001", "--out", out, "--hours", "6", "22",
                 "--risks", "Moderate Risk", "High Risk", "Critical", "--min-spike", "1.2"]) == 0
    names = capsys.readouterr().out.split()
    assert "overview/kpis" in names and len(names) == 34
    k = spark.read.parquet(f"{out}/overview/kpis").first()
    assert k.n_records == spark.read.parquet(f"{out}/data/info").first().n_records
