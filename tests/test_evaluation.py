"""Evaluation operators on hand fixture H3 and against MLlib's evaluator."""
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from hydrolens.operators import evaluation as J


@pytest.fixture()
def h3(spark):
    rows = [("a", 1, 0.9), ("b", 0, 0.8), ("c", 1, 0.8), ("d", 0, 0.1)]
    df = spark.createDataFrame(rows, "household_id string, label int, score double")
    return df.withColumns({"prediction": (F.col("score") > 0.5).cast("int"), "model": F.lit("m")})


def test_roc_and_auc(h3):
    pts = sorted((r.fpr, r.tpr) for r in J.roc_curve(h3).collect())
    assert pts == [(0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0)]
    assert J.auc_roc(h3).first().auc == 0.875


def test_confusion_and_metrics(h3):
    cm = {(r.actual, r.predicted): r.n for r in J.confusion_matrix(h3).collect()}
    assert cm == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 2}
    m = {r.metric: r.value for r in J.classification_metrics(h3).collect()}
    assert m["accuracy"] == 0.75 and m["precision"] == pytest.approx(2 / 3) and m["recall"] == 1.0
    assert m["f1"] == pytest.approx(0.8)
    rep = {r["class"]: r for r in J.classification_report(h3).collect()}
    assert rep["High Risk"].support == 2 and rep["accuracy"].f1 == 0.75


def test_auc_equals_mllib_evaluator(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("household_id"),
                                 (F.col("id") % 3 == 0).cast("int").alias("label"),
                                 F.round((F.col("id") * 7919 % 101) / 100.0 + (F.col("id") % 3 == 0).cast("int") * 0.2, 6)
                                 .alias("score"))
    df = df.withColumns({"prediction": (F.col("score") > 0.5).cast("int"), "model": F.lit("m")})
    ours = J.auc_roc(df).first().auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label")
    theirs = ev.evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert ours == pytest.approx(theirs, abs=1e-12)
    pts = [(r.fpr, r.tpr) for r in J.roc_curve(df).orderBy(F.desc("threshold")).collect()]
    assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(pts, pts[1:]))   # monotone


def test_single_class_auc_is_zero(spark):
    df = spark.createDataFrame([("a", 1, 0.3, 0, "m"), ("b", 1, 0.6, 1, "m")],
                               "household_id string, label int, score double, prediction int, model string")
    assert J.auc_roc(df).first().auc == 0.0


def test_ensemble_and_comparison(spark, h3):
    b = h3.withColumn("prediction", F.lit(1)).withColumn("score", F.lit(0.7))
    v = {r.household_id: r.verdict for r in J.ensemble(h3, b).collect()}
    assert v == {"a": "HIGH RISK", "b": "HIGH RISK", "c": "HIGH RISK", "d": "MANUAL REVIEW"}
    mt = J.metrics_table(h3.unionByName(b.withColumn("model", F.lit("n"))))
    cmp = {r.metric: r.winner_raw for r in J.model_comparison(mt, "m", "n").collect()}
    assert set(cmp) == set(J.METRIC_NAMES)
    assert J.metrics_summary(mt, "m", "n").count() == 9


def test_metrics_roundtrip_and_missing(spark, h3, tmp_path):
    mt = J.metrics_table(h3)
    J.save_metrics(mt, str(tmp_path / "m"))
    back = J.load_metrics(spark, str(tmp_path / "m"))
    assert back.exceptAll(mt).count() == 0 and mt.exceptAll(back).count() == 0
    assert J.load_metrics(spark, str(tmp_path / "missing")) is None
    cm = J.confusion_matrix(h3)
    assert sum(r.n for r in cm.collect()) == h3.count()        # cells sum to the scored rows


def test_many_scores_by_ranges(spark):
    """A million distinct scores, crowded near 1, against numpy; no window ranks a model's score groups at once."""
    import numpy as np
    sc = spark.range(1_000_000).select(
        (F.col("id") % 2).cast("string").alias("model"), (F.pmod(F.hash("id"), F.lit(10)) < 3).cast("int").alias("label"),
        (1 - F.exp(-F.col("id") / 40_000)).alias("score"), F.lit(1).alias("prediction"))
    rows = sc.select("model", "label", "score").toArrow()
    curve = J.roc_curve(sc).where("threshold < 2")
    points, areas = curve.toArrow(), {r.model: r.auc for r in J.auc_roc(sc).collect()}
    for m in ("0", "1"):
        own = rows.filter(np.array(rows["model"]) == m)
        score, label = np.array(own["score"]), np.array(own["label"])
        order = np.argsort(-score)
        p, n = np.cumsum(label[order]), np.cumsum(1 - label[order])
        last = np.append(score[order][1:] != score[order][:-1], True)
        got = points.filter(np.array(points["model"]) == m).sort_by([("threshold", "descending")])
        assert len(got) == last.sum() > 450_000
        assert np.array_equal(np.array(got["fpr"]), n[last] / n[-1]) and np.array_equal(np.array(got["tpr"]), p[last] / p[-1])
        assert areas[m] == pytest.approx(np.trapezoid(np.append(0, p[last] / p[-1]), np.append(0, n[last] / n[-1])), abs=1e-9)
    plan = curve._jdf.queryExecution().optimizedPlan().toString()
    ranked = [line for line in plan.splitlines() if "Window [" in line and "score" in line.split("], [")[-1]]
    assert ranked and all("_fine" in line for line in ranked)
