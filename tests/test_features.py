"""Household features, labels and split."""
import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from hydrolens.operators import features as HF
from hydrolens.operators.enrich import enrich
from hydrolens.sources.fixtures import raw_from_events


def test_features_h1(h1):
    f = {r.household_id: r for r in HF.household_features(h1).collect()}
    a, b, c = f["HH000001"], f["HH000002"], f["HH000003"]
    assert (a.avg_usage, a.max_usage, a.night_avg_usage, a.day_avg_usage) == (30.0, 60.0, 20.0, 40.0)
    assert a.std_usage == pytest.approx(21.602469) and a.night_day_ratio == 0.5 and a.usage_range == 30.0
    assert a.cv_usage == pytest.approx(0.720082, abs=1e-6)
    assert b.avg_usage == pytest.approx(30.666667) and b.std_usage == pytest.approx(16.165808)
    assert b.night_avg_usage == 0.0 and b.day_avg_usage == pytest.approx(30.666667) and b.night_day_ratio == 0.0
    assert b.cv_usage == pytest.approx(0.527146, abs=1e-6)
    assert (c.avg_usage, c.std_usage, c.night_avg_usage, c.day_avg_usage, c.night_day_ratio) == (8.0, 0.0, 8.0, 8.0, 1.0)
    live = {r.household_id: r for r in HF.household_features(h1, "live").collect()}
    assert live["HH000003"].night_day_ratio == 0.0 and live["HH000003"].cv_usage == 0.0


def test_labels_h1(h1):
    hf = HF.household_features(h1)
    q = {r.household_id: r.is_high_risk for r in HF.label_quantile(hf).collect()}
    assert q == {"HH000001": 0, "HH000002": 1, "HH000003": 0}
    rule = {r.household_id: r.is_high_risk for r in HF.label_rule(hf).collect()}
    assert rule == {"HH000001": 1, "HH000002": 1, "HH000003": 0}


def test_single_class_label_fails_clearly(spark, h1):
    hf = HF.household_features(h1).withColumn("avg_leak_prob", F.lit(0.5))
    with pytest.raises(Exception, match="single class"):
        HF.label_quantile(hf).collect()


def test_conditional_aggregate_equals_separate_aggregates(spark):
    """One aggregate with conditions gives what an aggregate for each condition and joins give."""
    r = enrich(raw_from_events(spark, SF0001))
    night = r.where("hour BETWEEN 0 AND 5").groupBy("household_id").agg(F.avg("water_usage_liters").alias("n"))
    day = r.where("hour BETWEEN 6 AND 23").groupBy("household_id").agg(F.avg("water_usage_liters").alias("d"))
    hf = HF.household_features(r).join(night, "household_id", "left").join(day, "household_id", "left")
    off = hf.where((F.abs(F.col("night_avg_usage") - F.coalesce("n", F.lit(0.0))) > 1e-9)
                   | (F.abs(F.col("day_avg_usage") - F.coalesce("d", "avg_usage")) > 1e-9))
    assert off.count() == 0 and hf.count() > 0


def test_split_exact_disjoint_complete(spark):
    r = enrich(raw_from_events(spark, SF0001))
    lab = HF.label_quantile(HF.household_features(r))
    s = HF.stratified_split(lab)
    assert s.count() == lab.count() and s.select("household_id").distinct().count() == lab.count()
    for row in s.groupBy("is_high_risk").agg(F.count(F.lit(1)).alias("n"), F.sum("is_test").alias("t")).collect():
        assert row.t == int(0.2 * row.n + 0.5)
    # same split whatever the partitioning
    s2 = HF.stratified_split(lab.repartition(5))
    assert s.exceptAll(s2).count() == 0


def test_split_brute_force(spark):
    """Bucketed cut equals a plain per-class rank on a fixture with many households."""
    df = spark.range(5000).select(F.format_string("HH%06d", "id").alias("household_id"),
                                  (F.col("id") % 3 == 0).cast("int").alias("is_high_risk"))
    s = HF.stratified_split(df)
    from pyspark.sql import Window
    w = Window.partitionBy("is_high_risk").orderBy(F.md5(F.concat("household_id", F.lit(":42"))), "household_id")
    ref = df.withColumn("rn", F.row_number().over(w)).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("is_high_risk"))).select(
        "household_id", "is_high_risk", (F.col("rn") <= F.floor(0.2 * F.col("n") + 0.5)).cast("int").alias("is_test"))
    assert s.exceptAll(ref).count() == 0 and ref.exceptAll(s).count() == 0


def test_class_weights_and_distribution(spark, h1):
    hf = HF.label_quantile(HF.household_features(h1))
    cw = HF.class_weights(hf).first()
    assert (cw.n_neg, cw.n_pos, cw.ratio) == (2, 1, 2.0)
    d = {r.label: (r.n, r.pct) for r in HF.label_distribution(hf).collect()}
    assert d[1][0] == 1 and sum(v[1] for v in d.values()) == pytest.approx(100.0)
