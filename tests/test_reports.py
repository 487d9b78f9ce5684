"""Dashboard operators on hand fixture H1 (answers worked by hand in FIXTURES.md §3)."""
import pytest
from pyspark.sql import functions as F

from hydrolens.operators import filters as C
from hydrolens.operators import reports as E


def test_overview_kpis(h1):
    r = E.overview_kpis(h1).first()
    assert (r.n_records, r.n_households, r.n_leaks, r.n_high_risk, r.n_critical) == (8, 3, 3, 2, 2)
    assert r.avg_usage == pytest.approx(27.5)
    assert r.leak_pct == pytest.approx(37.5)
    assert r.avg_spike == pytest.approx(13.75)


def test_spike_histogram_bins_and_anomalies(h1):
    got = [(r.bucket, r.n_records) for r in E.spike_histogram(h1).orderBy("ord").collect()]
    assert got == [("<1", 2), ("1–2", 2), ("2–3", 2), ("3–4", 0), (">4", 0)]
    a = E.anomaly_counts(h1).first()
    assert (a.n_gt2, a.n_gt3) == (3, 1) and a.pct_gt2 == 37.5 and a.pct_gt3 == 12.5
    w = E.worst_spike(h1).first()
    assert (w.household_id, w.spike_ratio) == ("HH000002", 99.5)


def test_top_high_risk(h1):
    rows = E.top_high_risk(h1).collect()
    assert [r.household_id for r in rows] == ["HH000001", "HH000002"]
    a, b = rows
    assert (a.risk_level, a.avg_leak_prob, a.avg_spike, a.leak_events, a.avg_usage) == ("Critical", 0.95, 3.0, 1, 60.0)
    assert (b.risk_level, b.avg_leak_prob, b.avg_spike, b.leak_events, b.avg_usage) == ("High Risk", 0.92, 51.0, 2, 26.0)
    d = E.top_high_risk_display(h1).first()
    assert (d["Leak Probability"], d["Avg Spike Ratio"], d["Avg Usage"]) == ("0.9500", "3.00", "60.0 L")


def test_household_summary_mode_tie_and_order(h1):
    rows = E.household_summary(h1).collect()
    assert [r.household_id for r in rows] == ["HH000002", "HH000001", "HH000003"]
    assert rows[0].leak_severity == "Critical Leak"     # three-way tie -> smallest label
    assert rows[0].risk_level == "High Risk" and rows[0].avg_leak_prob == pytest.approx(0.713333)
    assert rows[1].leak_severity == "Normal" and rows[1].avg_spike == 1.625


def test_household_kpi_last_risk(h1):
    got = {r.household_id: (r.risk_level, r.leak_status) for r in E.household_kpi(h1).collect()}
    assert got == {"HH000001": ("Low Risk", "danger"), "HH000002": ("Critical", "danger"),
                   "HH000003": ("Low Risk", "success")}


def test_profiles(h1):
    p = E.peak_hours(h1).first()
    assert (p.peak_hour, p.peak_avg, p.low_hour, p.low_avg) == (12, 50.0, 5, 8.0)
    wd = {r.day_of_week: r.avg_usage for r in E.weekday_profile(h1).collect()}
    assert wd == {"Monday": 34.0, "Tuesday": 10.0, "Thursday": 30.0}
    m = {r.month: (round(r.avg_usage, 6), r.leak_events) for r in E.monthly(h1).collect()}
    assert m == {"2024-01": (27.142857, 3), "2024-02": (30.0, 0)}
    sbm = {(r.month, r.leak_severity): r.n for r in E.severity_by_month(h1).collect()}
    assert sbm == {("2024-01", "Low Risk"): 1, ("2024-01", "Moderate Risk"): 1, ("2024-01", "High Risk"): 1,
                   ("2024-01", "Critical Leak"): 2}


def test_shares_sum_to_100(h1):
    for df in (E.severity_share(h1), E.risk_share(h1)):
        assert sum(r.pct for r in df.collect()) == pytest.approx(100.0)


def test_histogram_total_plus_dropped_equals_rows(h1):
    n = sum(r.n for r in E.usage_histogram(h1).collect())
    assert n == h1.count()
    assert E.usage_histogram(h1.where("false")).count() == 0


def test_heatmap_wide_matches_long(h1):
    long = {(r.day_of_week, r.hour): r.avg_usage for r in E.heatmap(h1).collect()}
    wide = E.heatmap(h1, wide=True).collect()
    for r in wide:
        for h in range(24):
            assert r[f"h{h:02d}"] == long.get((r.day_of_week, h))


def test_describe_and_box(h1):
    d = {r.column: r for r in E.describe_numeric(h1, ["water_usage_liters", "hour"]).collect()}
    assert d["water_usage_liters"]["count"] == 8 and d["water_usage_liters"]["max"] == 60.0
    b = E.usage_box(h1).collect()
    assert {r.risk_level for r in b} <= {"Low Risk", "Moderate Risk", "High Risk", "Critical"}


def test_samples_are_exact_and_repeatable(h1):
    a = [r.timestamp for r in E.sample_rows(h1, 5).collect()]
    b = [r.timestamp for r in E.sample_rows(h1.repartition(4), 5).collect()]
    assert len(a) == 5 and sorted(a) == sorted(b)
    hh = E.sample_households(h1, 2).select("household_id").distinct().count()
    assert hh == 2


def test_filters(h1, spark):
    f = C.global_filter(h1, risks=["Critical", "High Risk"], hours=(6, 23), min_spike=2.0)
    assert sorted(r.spike_ratio for r in f.collect()) == [2.5, 3.0, 99.5]
    assert C.global_filter(h1, households=["HH000003"]).count() == 1
    assert C.global_filter(h1, risks=["nope"]).count() == 0            # empty, not an error
    assert C.is_empty(C.global_filter(h1, risks=["nope"]))
    assert C.household_search(h1, "HH.*2").select("household_id").distinct().count() == 1
    assert C.household_search(h1, "hh000").count() == 8                 # case-insensitive
    assert C.household_search(h1, "").count() == 8
    opts = C.filter_options(h1.union(h1.limit(1).withColumn("risk_level", F.lit("Odd"))))
    odd = opts.where("facet = 'risk_level' AND value = 'Odd'").first()
    assert odd.ord == 99


def test_api_conveniences(h1):
    assert E.share(h1, "risk_level").count() == E.risk_share(h1).count()
    assert E.top_high_risk(h1, fmt=True).columns[0] == "Household"
    assert C.search(h1, "hh000001").count() == 4 and C.timeline(h1, "HH000003").count() == 1
