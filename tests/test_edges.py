"""Edge inputs of FIXTURES.md §6: NULL labels/spikes, ties, row order, band edges."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from hydrolens.operators import filters as C
from hydrolens.operators import reports as E
from hydrolens.schema import READINGS


@pytest.fixture()
def with_nulls(spark, h1):
    extra = spark.createDataFrame([
        ("HH000004", dt.datetime(2024, 1, 3, 7), 7, 5.0, None, 0.1, 0, "Normal", None),
        ("HH000004", dt.datetime(2024, 1, 3, 8), 8, 5.0, 2.5, 0.1, 0, None, "Low Risk"),
    ], READINGS)
    return h1.unionByName(extra)


def test_null_labels_drop_from_groups_not_totals(with_nulls):
    k = E.overview_kpis(with_nulls).first()
    assert k.n_records == 10 and k.n_households == 4
    assert sum(r.n_records for r in E.risk_distribution(with_nulls).collect()) == 9
    assert sum(r.n_records for r in E.severity_distribution(with_nulls).collect()) == 9
    assert sum(r.n_records for r in E.spike_histogram(with_nulls).collect()) == 7   # 0.0, 99.5 and NULL in no bin
    a = E.anomaly_counts(with_nulls).first()
    assert (a.n_gt2, a.pct_gt2) == (4, 40.0)                                        # denominator counts NULL rows


def test_topk_ties_smaller_id_first(spark):
    rows = [(f"HH00000{i}", dt.datetime(2024, 1, 1, i), i, 1.0, 1.0, 0.5, 1, "Moderate Risk", "Moderate Risk")
            for i in (3, 1, 2)]
    r = spark.createDataFrame(rows, READINGS)
    assert [x.household_id for x in E.top10_leak_events(r).collect()] == ["HH000001", "HH000002", "HH000003"]
    assert [x.household_id for x in E.top5_leak_events(r.repartition(3)).collect()] == ["HH000001", "HH000002",
                                                                                       "HH000003"]


def test_row_order_and_partitioning_do_not_matter(h1):
    shuffled = h1.repartition(5).orderBy(F.rand(3))
    for fn in (E.household_kpi, E.household_summary, E.insights, E.usage_box, E.top_high_risk):
        a, b = fn(h1).collect(), fn(shuffled).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_bands_at_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.99, 1.0, 1.49, 1.5, 3.0, 3.01)], "spike_ratio double")
    got = [r.band for r in E.spike_band(df).collect()]
    assert got == ["normal", "expected", "expected", "moderate", "moderate", "severe"]
    p = spark.createDataFrame([(x,) for x in (0.29, 0.3, 0.69, 0.7)], "leak_probability double")
    assert [r.band for r in E.probability_band(p).collect()] == ["low", "medium", "medium", "high"]
    s = spark.createDataFrame([(x,) for x in (2.0, 2.01, 3.0, 3.01)], "spike_ratio double").select(
        F.lit("h").alias("household_id"), F.lit(None).cast("timestamp_ntz").alias("timestamp"),
        F.lit(1.0).alias("water_usage_liters"), "spike_ratio", F.lit("Low Risk").alias("risk_level"))
    assert [r.anomaly for r in E.anomaly_band(s).collect()] == ["Normal", "Spike > 2", "Spike > 2", "Spike > 3"]


def test_explore_nulls_last_both_ways(with_nulls):
    cols = ["household_id", "spike_ratio"]
    asc = [r.spike_ratio for r in E.explore(with_nulls, cols, "spike_ratio", True).collect()]
    desc = [r.spike_ratio for r in E.explore(with_nulls, cols, "spike_ratio", False).collect()]
    assert asc[-1] is None and desc[-1] is None and asc[0] == 0.0 and desc[0] == 99.5
    with pytest.raises(ValueError):
        E.project(with_nulls, ["nope"])


def test_timeline_and_leak_events(h1):
    tl = C.household_timeline(h1, "HH000002").collect()
    assert [r.timestamp.hour for r in tl] == [6, 12, 18]
    le = C.leak_events(h1, "HH000002").collect()
    assert [r.leak_probability for r in le] == [0.85, 0.99]
    assert C.leak_events(h1).count() == 3
    info = E.dataset_info(h1).first()
    assert (info.n_records, str(info.min_date), str(info.max_date)) == (8, "2024-01-01", "2024-02-01")


def test_first_skips_missing_last_keeps_it(spark):
    rows = [("HH000001", dt.datetime(2024, 1, 1, h), h, 10.0, 1.0, 0.95, 1, "Critical Leak", risk)
            for h, risk in ((1, None), (2, "Critical"), (3, "High Risk"), (4, None))]
    r = spark.createDataFrame(rows, READINGS)
    assert E.top_high_risk(r).first().risk_level == "Critical"
    assert E.household_summary(r).first().risk_level == "Critical"
    assert E.household_kpi(r).first().risk_level is None


def test_tier_of_household_without_known_labels_is_null(spark):
    from hydrolens.operators.enrich import household_tier
    r = spark.createDataFrame([("HH000009", dt.datetime(2024, 1, 1), 0, 1.0, 1.0, 0.1, 0, "Normal", "Odd")], READINGS)
    assert household_tier(r).first().tier is None
