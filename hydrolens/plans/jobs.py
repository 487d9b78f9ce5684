"""Batch jobs with the reference's workflow: enrich once, train and save, then query."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens.operators import evaluation as J
from hydrolens.operators import ml as M
from hydrolens.operators.enrich import enrich
from hydrolens.plans import catalog
from hydrolens.session import tune_for_scale
from hydrolens.sources.fixtures import RAW_SOURCES
from hydrolens.sources.writers import write_readings


def enrich_job(spark: SparkSession, sf_dir: str, out: str, source: str = "events") -> None:
    """Raw test tables -> enriched readings (snappy Parquet, partitioned by month)."""
    tuned(spark, sf_dir, source)
    write_readings(enrich(RAW_SOURCES[source](spark, sf_dir)), out)


def tuned(spark: SparkSession, sf_dir: str, source: str) -> None:
    """Size shuffles and scans from the bytes of the table that a job reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{source}.parquet")  # noqa: SLF001 - no public Python API
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    tune_for_scale(spark, fs.getContentSummary(path).getLength())


def train_job(spark: SparkSession, sf_dir: str, out: str) -> DataFrame:
    """Fit both models on the training split; save them, the scaler, and all that the comparison page reads.

    Returns the nine-row metrics summary (five metrics + confusion counts).
    """
    test = catalog.split(spark, sf_dir).where(F.col("is_test") == 1)
    models = catalog.models(spark, sf_dir, anew=True)
    for k, m in models.items():
        M.save_model(m, f"{out}/models/{k}")
        M.fit_scaler(catalog.split(spark, sf_dir).where(F.col("is_test") == 0)).write.mode("overwrite").parquet(
            f"{out}/models/{k}_scaler")
    J.save_metrics(catalog.comparison(spark, sf_dir), f"{out}/comparison")
    scored = M.score(models["rf"], test, "rf").unionByName(M.score(models["gbt"], test, "gbt"))
    metrics = J.metrics_table(scored)
    J.save_metrics(metrics, f"{out}/metrics")
    return J.metrics_summary(J.load_metrics(spark, f"{out}/metrics"), "rf", "gbt")


def dashboard_tables(r: DataFrame, search: str = "") -> dict[str, DataFrame]:
    """Every table behind the dashboard pages for already-filtered readings (page/table -> frame)."""
    from hydrolens.operators import filters as C
    from hydrolens.operators import reports as E
    return {
        "overview/kpis": E.overview_kpis(r), "overview/risk_distribution": E.risk_distribution(r),
        "overview/spike_histogram": E.spike_histogram(r), "overview/daily_leaks": E.daily_leaks(r),
        "severity/distribution": E.severity_distribution(r), "severity/share": E.severity_share(r),
        "severity/by_month": E.severity_by_month(r), "severity/usage": E.usage_by_severity(r),
        "risk/distribution": E.risk_distribution_ordered(r), "risk/share": E.risk_share(r),
        "risk/top_high_risk": E.top_high_risk(r, fmt=True), "risk/household_summary": E.household_summary_display(r, search),
        "consumption/hourly": E.hourly_profile(r), "consumption/peak_hours": E.peak_hours(r),
        "consumption/histogram": E.usage_histogram(r), "consumption/weekday": E.weekday_profile(r),
        "consumption/box": E.usage_box(r), "consumption/heatmap": E.heatmap(r, wide=True),
        "anomalies/counts": E.anomaly_counts(r), "anomalies/worst": E.worst_spike(r),
        "anomalies/scatter": E.anomaly_band(E.sample_rows(r)), "anomalies/daily_gt2": E.daily_spikes_2(r),
        "anomalies/daily_gt3": E.daily_spikes_3(r), "anomalies/table": E.anomaly_table(r),
        "explorer/kpis": E.household_kpi(r), "explorer/severity": E.household_severity(r),
        "explorer/leak_events": C.leak_events(r),
        "insights/panel": E.insights(r), "insights/text": E.insights_text(r),
        "insights/top10_leaks": E.top10_leak_events(r), "insights/top10_spike": E.top10_avg_spike(r),
        "insights/monthly": E.monthly(r), "data/describe": E.describe_numeric(r, catalog.EXPLORE_COLS),
        "data/info": E.dataset_info(r),
    }


def model_tables(spark: SparkSession, sf_dir: str, r: DataFrame) -> dict[str, DataFrame]:
    """Tables of the prediction and comparison pages, for households of already-filtered readings."""
    from hydrolens.operators import features as HF
    from hydrolens.operators import filters as C
    live = HF.household_features(r, "live")
    models = catalog.models(spark, sf_dir)
    scores = {k: M.score(m, live, k, label=None) for k, m in models.items()}
    test = catalog.test_scores(spark, sf_dir)
    metrics = J.metrics_table(test)
    return {
        "prediction/features": HF.features_shown(live), "prediction/scores": scores["rf"].unionByName(scores["gbt"]),
        "prediction/whatif": M.whatif(live, catalog.WHATIF_SCENARIOS, models), "prediction/filters": C.filter_options(r),
        "comparison/metrics": J.model_comparison(metrics, "rf", "gbt"), "comparison/tally": J.comparison_tally(metrics, "rf", "gbt"),
        "comparison/summary": J.metrics_summary(metrics, "rf", "gbt"), "comparison/confusion": J.confusion_matrix(test),
        "comparison/roc": J.roc_curve(test), "comparison/report": J.classification_report(test),
        "comparison/importance": M.feature_importance(spark, models), "comparison/card": M.model_card(catalog.split(spark, sf_dir)),
        "comparison/ensemble": J.ensemble(scores["rf"], scores["gbt"]),
    }


def dashboard_job(spark: SparkSession, sf_dir: str, out: str, source: str = "events", search: str = "",
                  models: bool = False, **spec) -> list[str]:
    """Apply the sidebar filter once (pushed to the readings scan) and write every page's tables.

    ``models`` adds the prediction and comparison pages. A filter that selects no
    reading is an error, as the dashboard stops there.
    """
    from hydrolens.operators import filters as C
    from hydrolens.sources.store import readings
    tuned(spark, sf_dir, source)
    r = C.global_filter(readings(spark, sf_dir, source), **spec)
    if C.is_empty(r):
        raise ValueError(f"no reading passes the filter {spec}")
    tables = dashboard_tables(r, search) | (model_tables(spark, sf_dir, r) if models else {})
    written = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        written.append(name)
    return written
