"""MLlib models: behaviour, not values (trap 10 of the survey: the label is derived
from the same source as the inputs, so no accuracy target is asserted)."""
import pytest
from pyspark.sql import functions as F

from hydrolens.operators import features as HF
from hydrolens.operators import ml as M
from hydrolens.operators.enrich import enrich
from hydrolens.schema import LEGACY_FEATURES
from hydrolens.sources.fixtures import raw_from_lineitem


@pytest.fixture(scope="module")
def data(spark):
    r = enrich(raw_from_lineitem(spark, "/root/testdata/sf0.01"))
    return HF.stratified_split(HF.label_quantile(HF.household_features(r))).cache()


def test_rf_and_gbt_behaviour(spark, data, tmp_path):
    train = data.where("is_test = 0")
    rf = M.train(train, "rf", params={"numTrees": 10})
    gbt = M.train(train, "gbt", params={"maxIter": 5})
    for m, name in ((rf, "rf"), (gbt, "gbt")):
        sc = M.score(m, data, name)
        assert sc.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
        assert set(r.prediction for r in sc.collect()) <= {0, 1}
    imp = M.feature_importance(spark, {"rf": rf, "gbt": gbt})
    assert sum(r.rf for r in imp.collect()) == pytest.approx(1.0)
    path = str(tmp_path / "rf")
    M.save_model(rf, path)
    again = M.load_model(path)
    a = M.score(rf, data, "rf").orderBy("household_id").collect()
    b = M.score(again, data, "rf").orderBy("household_id").collect()
    assert a == b
    assert M.load_model(str(tmp_path / "missing")) is None


def test_same_seed_same_predictions(spark, data):
    train = data.where("is_test = 0")
    a = M.score(M.train(train, "rf", params={"numTrees": 5}), data, "rf").orderBy("household_id").collect()
    b = M.score(M.train(train, "rf", params={"numTrees": 5}), data, "rf").orderBy("household_id").collect()
    assert a == b


def test_single_class_gives_constant_model(spark, data):
    one = data.withColumn("is_high_risk", F.lit(0))
    m = M.train(one, "rf")
    assert {r.score for r in M.score(m, data, "c").collect()} == {0.0}


def test_whatif(spark, data):
    train = data.where("is_test = 0")
    rf = M.train(train, "rf", params={"numTrees": 5})
    some = data.select("household_id").orderBy("household_id").first()[0]
    sc = [M.Scenario("x2", "night_avg_usage", "mul", 2.0), M.Scenario("one", "max_spike_ratio", "set", 1.0, some)]
    out = M.whatif(data, sc, {"rf": rf})
    n = data.count()
    assert out.where("scenario = 'x2'").count() == n and out.where("scenario = 'one'").count() == 1
    noop = M.whatif(data, [M.Scenario("same", "avg_usage", "mul", 1.0)], {"rf": rf})
    assert noop.where("delta != 0").count() == 0
    with pytest.raises(ValueError):
        M.whatif(data, [M.Scenario("bad", "unknown", "set", 1.0)], {"rf": rf})


def test_legacy_feature_list():
    assert LEGACY_FEATURES == ["avg_usage", "max_usage", "std_usage", "night_avg_usage",
                               "avg_spike_ratio", "max_spike_ratio", "std_spike_ratio"]


def test_a_model_that_learned_nothing_fails_the_registered_checks(spark, monkeypatch):
    """Each model query has a flag that a constant answer turns false."""
    from conftest import SF0001
    from hydrolens.plans import catalog
    from hydrolens.schema import TRAIN_FEATURES
    dull = M.constant_model(spark, TRAIN_FEATURES, 0.4)
    for name in ("fitted", "model", "notebook_model"):
        monkeypatch.setattr(catalog, name, lambda *a: dull)
    monkeypatch.setattr(M, "train", lambda *a, **k: dull)
    for name in ("train_rf", "train_gbt", "train_rf_notebook", "score_households", "model_metrics", "model_roc_curve",
                 "model_auc_roc", "model_comparison_ml", "metrics_summary_ml", "feature_importance", "ensemble_verdict_ml",
                 "probability_band_model", "whatif_score", "cross_validate"):
        out = catalog.QUERIES[name](spark, SF0001)
        flags = [c for c, t in out.dtypes if t == "boolean"]
        assert any(not r[c] for r in out.collect() for c in flags), name


def test_boosting_runs_on_few_large_partitions(spark, monkeypatch):
    """45,000 rows: boosting's many short jobs get one task each, a forest's few long ones three."""
    from pyspark.sql import functions as F
    seen = {}

    class Spy:
        def __init__(self, stages):
            self.kind = type(stages[-1]).__name__

        def fit(self, df):
            seen[self.kind] = (df.rdd.getNumPartitions(), df.count())
    monkeypatch.setattr(M, "Pipeline", Spy)
    rows = spark.range(45_000).select(F.col("id").cast("string").alias("household_id"), (F.col("id") % 2).cast("int").alias("is_high_risk"),
                                      F.col("id").cast("double").alias("avg_usage"))
    for kind in ("rf", "gbt"):
        M.train(rows, kind, ["avg_usage"])
    assert seen == {"RandomForestClassifier": (3, 45_000), "GBTClassifier": (1, 45_000)}


def test_both_models_are_fitted_at_once(spark, monkeypatch):
    """Each fit waits until the other has begun; fits in turn would break the barrier."""
    import threading
    from conftest import SF0001
    from hydrolens.plans import catalog
    from hydrolens.schema import TRAIN_FEATURES
    dull, begun = M.constant_model(spark, TRAIN_FEATURES, 0.4), threading.Barrier(2)

    def train(*a, **k):
        begun.wait(60)
        return dull
    monkeypatch.setattr(M, "_models", {})
    monkeypatch.setattr(M, "load_model", lambda path: None)
    monkeypatch.setattr(M, "publish_model", lambda *a: None)
    monkeypatch.setattr(M, "train", train)
    assert catalog.models(spark, SF0001) == {"rf": dull, "gbt": dull}
    for name in ("model_classification_report", "feature_importance", "whatif_score", "score_households", "ensemble_verdict_ml"):
        M._models.clear()
        assert catalog.QUERIES[name](spark, SF0001).columns
