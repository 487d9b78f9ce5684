"""Nothing is cut or rounded before it is ranked, compared or fitted, and no label or row gets lost."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from hydrolens.operators import enrich as K
from hydrolens.operators import features as HF
from hydrolens.operators import reports as E
from hydrolens.schema import READINGS

T = dt.datetime


@pytest.fixture(scope="module")
def fine(spark):
    """Usage of three decimals and more, labels outside the vocabularies, rows without an hour."""
    rows = [
        ("HH1", T(2024, 1, 1, 1), 1, 0.004, 1.0, 0.10000004, 0, "Normal", "High Risk"),
        ("HH1", T(2024, 1, 1, 2), 2, 0.004, 1.0, 0.10000004, 0, "Odd", "High Risk"),
        ("HH1", T(2024, 1, 1, 3), None, 1.2345, 1.0, 0.10000004, 0, "Odd", "Weird"),
        ("HH2", T(2024, 1, 1, 1), 1, 7.0001234, 1.00000002, 0.10000006, 0, "Normal", "High Risk"),
        ("HH3", T(2024, 1, 1, 1), 1, 7.0, 1.00000001, 0.0999999999, 1, None, "Critical"),
    ]
    return spark.createDataFrame(rows, READINGS)


def one(df, **where):
    for c, v in where.items():
        df = df.where(F.col(c) == v)
    return df.first()


def test_means_are_whole(fine):
    hh1 = fine.where("household_id = 'HH1'")
    assert E.overview_kpis(hh1).first().avg_usage == pytest.approx(0.414167, abs=1e-9)
    assert one(E.usage_by_severity(hh1), leak_severity="Normal").avg_usage == 0.004
    assert one(HF.household_features(hh1)).avg_usage == pytest.approx(1.2425 / 3, rel=1e-12)


def test_ranks_use_whole_means(fine):
    assert [r.household_id for r in E.top_high_risk(fine).collect()] == ["HH2", "HH1", "HH3"]
    assert [r.household_id for r in E.top10_avg_spike(fine).collect()] == ["HH2", "HH3", "HH1"]
    assert [r.household_id for r in E.household_summary(fine).collect()][0] == "HH2"


def test_thresholds_use_whole_means(fine):
    status = {r.household_id: r.prob_status for r in E.household_kpi(fine).collect()}
    assert status == {"HH1": "danger", "HH2": "danger", "HH3": ""}


def test_unknown_labels_stay(fine):
    assert one(E.household_kpi(fine), household_id="HH1").risk_level == "Weird"
    summary = one(E.household_summary(fine), household_id="HH1")
    assert (summary.risk_level, summary.leak_severity) == ("High Risk", "Odd")


def test_rows_without_an_hour_are_in_no_group(fine):
    assert [r.hour for r in E.hourly_profile(fine).collect()] == [1, 2]
    assert {r.hour for r in E.heatmap(fine).collect()} == {1, 2}
    assert E.heatmap(fine, wide=True).first().day_of_week == "Monday"


def test_ties_round_to_even(spark):
    x = spark.createDataFrame([(0.125,), (0.375,), (2.5,)], "x double").select(E._fixed("x", 2).alias("a"), E._fixed("x", 0).alias("b"))
    assert [tuple(r) for r in x.collect()] == [("0.12", "0"), ("0.38", "0"), ("2.50", "2")]


def test_small_deviations_still_score(spark):
    base = T(2024, 1, 1)
    rows = [("HH1", base + dt.timedelta(hours=i), i % 24, 5 + (i % 2) * 1e-7, 1.0, 0.1, 0, "Normal", "Low Risk") for i in range(20)]
    r = spark.createDataFrame(rows, READINGS)
    z = [x.z for x in K.zscore(r).orderBy("timestamp").collect()]
    assert z[0] is None and abs(z[-1]) > 0.5
    flat = r.withColumn("water_usage_liters", F.lit(0.1))
    assert [x.z for x in K.zscore(flat).collect()] == [None] * 20


def test_raw_litres_keep_their_decimals(spark):
    from hydrolens.sources.fixtures import hourly_events
    ev = spark.createDataFrame([(T(2024, 1, 1, 1, i), 1, 0.004) for i in range(3)], "ts timestamp_ntz, user_id long, value double")
    assert float(hourly_events(ev).first().usage) == 0.012
