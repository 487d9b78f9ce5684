"""Named query plans: each takes (spark, sf_dir) and returns a lazy DataFrame.

Dashboard operators read the materialised enriched readings of the folder
(see ``sources.store``); the enrichment queries recompute from the raw tables.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens.functions.columns import shown
from hydrolens.operators import enrich as K
from hydrolens.operators import evaluation as J
from hydrolens.operators import features as HF
from hydrolens.operators import filters as C
from hydrolens.operators import ml as M
from hydrolens.operators import reports as E
from hydrolens.schema import EXPLORE_COLS, NOTEBOOK_FEATURES
from hydrolens.session import scratch_path, stable_path
from hydrolens.sources import instalments
from hydrolens.sources.fixtures import hourly_events, raw_from_events, raw_from_lineitem, table
from hydrolens.sources.readers import CSV_NAME, PARQUET_NAME, load_readings, read_readings
from hydrolens.sources.store import materialize, readings, version_key
from hydrolens.sources.writers import export_csv, write_readings
from hydrolens.streaming import rollup as S

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered examples (the dashboard's widget values).
FILTER_SPEC = dict(risks=["Moderate Risk", "High Risk", "Critical"], severities=None, hours=(6, 22), min_spike=1.2)
SEARCH_PATTERN = "hh0000[1-3]"


def _ev(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d, "events")


def _li(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d, "lineitem")


def on_events(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: fn(_ev(spark, d))


def on_lineitem(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: fn(_li(spark, d))


def _enrich_instalments(spark: SparkSession, d: str) -> DataFrame:
    """A5/K1: the events come in two instalments, of earlier days and of later days with late events of earlier ones."""
    base, events = scratch_path(spark, "instalments"), table(spark, d, "events")
    middle = events.agg(F.expr("timestampadd(SECOND, timestampdiff(SECOND, min(ts), max(ts)) DIV 2, min(ts))")).scalar()
    second = F.coalesce((F.col("ts") >= middle) | (F.pmod("event_id", F.lit(97)) == 0), F.lit(True))
    for part in (~second, second):
        events.where(part).write.mode("append").parquet(f"{base}/source")
        instalments.add_files(spark, f"{base}/source", f"{base}/store", hourly_events)
    return instalments.read_store(spark, f"{base}/store")


def _scan_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    export_csv(_ev(spark, d), path)
    return read_readings(spark, path, "csv")


def _sink_parquet(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "parquet")
    write_readings(_ev(spark, d), path)
    return read_readings(spark, path, "parquet")


def _export_filtered_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "export")
    f = C.global_filter(_ev(spark, d), **FILTER_SPEC)
    export_csv(E.explore(f, EXPLORE_COLS, "spike_ratio", ascending=False), path)
    return read_readings(spark, path, "csv", EXPLORE_COLS)


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    r = _ev(spark, d)
    return C.household_timeline(r, E.top10_leak_events(r).limit(1))


QUERIES: dict[str, Query] = {
    # enrichment from raw tables (K1, K5-K8)
    "enrich_readings": lambda s, d: K.enrich(raw_from_events(s, d)),
    "enrich_readings_lineitem": lambda s, d: K.enrich(raw_from_lineitem(s, d)),
    "enrich_instalments": _enrich_instalments,
    # sources and sinks
    "scan_parquet": on_events(lambda r: r),
    "scan_csv": _scan_csv,
    "sink_parquet": _sink_parquet,
    "export_filtered_csv": _export_filtered_csv,
    # projections (B)
    "derive_calendar": on_events(E.with_calendar),
    "ordinal_encode": on_events(E.with_ordinals),
    "project_columns": on_events(lambda r: E.project(r, ["household_id", "timestamp", "spike_ratio", "risk_level"])),
    "anomaly_band": on_events(E.anomaly_band),
    "methodology_spike_band": on_events(E.spike_band),
    "probability_band": on_events(lambda r: E.probability_band(r, "leak_probability")),
    "dataset_info": on_events(E.dataset_info),
    "dataset_info_lineitem": on_lineitem(E.dataset_info),
    # filters (C)
    "global_filter": on_events(lambda r: C.global_filter(r, **FILTER_SPEC)),
    "filter_options": on_events(C.filter_options),
    "household_search": on_events(lambda r: C.household_search(r, SEARCH_PATTERN)),
    "leak_events": on_events(C.leak_events),
    "household_timeline": _timeline,
    # aggregations (E)
    "overview_kpis": on_events(E.overview_kpis),
    "overview_kpis_filtered": on_events(lambda r: E.overview_kpis(C.global_filter(r, **FILTER_SPEC))),
    "risk_distribution": on_events(E.risk_distribution),
    "risk_distribution_ordered": on_events(E.risk_distribution_ordered),
    "severity_distribution": on_events(E.severity_distribution),
    "severity_share": on_events(E.severity_share),
    "risk_share": on_events(E.risk_share),
    "spike_histogram": on_events(E.spike_histogram),
    "daily_leaks": on_events(E.daily_leaks),
    "severity_by_month": on_events(E.severity_by_month),
    "severity_by_month_lineitem": on_lineitem(E.severity_by_month),
    "usage_by_severity": on_events(E.usage_by_severity),
    "top_high_risk": on_events(E.top_high_risk),
    "top_high_risk_display": on_events(E.top_high_risk_display),
    "household_summary": on_events(E.household_summary),
    "household_summary_search": on_events(lambda r: E.household_summary(r, SEARCH_PATTERN)),
    "household_summary_display": on_events(lambda r: E.household_summary_display(r, SEARCH_PATTERN)),
    "hourly_profile": on_events(E.hourly_profile),
    "peak_hours": on_events(E.peak_hours),
    "usage_histogram": on_events(E.usage_histogram),
    "weekday_profile": on_events(E.weekday_profile),
    "usage_box_by_risk": on_events(E.usage_box),
    "usage_heatmap_long": on_events(E.heatmap),
    "usage_heatmap": on_events(lambda r: E.heatmap(r, wide=True)),
    "anomaly_counts": on_events(E.anomaly_counts),
    "worst_spike": on_events(E.worst_spike),
    "daily_spikes_2": on_events(E.daily_spikes_2),
    "daily_spikes_3": on_events(E.daily_spikes_3),
    "household_kpi": on_events(E.household_kpi),
    "household_severity": on_events(E.household_severity),
    "smart_insights": on_events(E.insights),
    "smart_insights_text": on_events(E.insights_text),
    "top10_leak_events": on_events(E.top10_leak_events),
    "top5_leak_events": on_events(E.top5_leak_events),
    "top10_avg_spike": on_events(E.top10_avg_spike),
    "monthly_rollup": on_events(E.monthly),
    "monthly_rollup_lineitem": on_lineitem(E.monthly),
    "describe_numeric": on_events(lambda r: E.describe_numeric(r, EXPLORE_COLS)),
    # sort / top-k / sample (F)
    "anomaly_table": on_events(E.anomaly_table),
    "explore_sorted": on_events(lambda r: E.explore(C.global_filter(r, **FILTER_SPEC), EXPLORE_COLS,
                                                    "spike_ratio", ascending=False)),
    "sample_scatter": on_events(E.sample_rows),
    "sample_households": on_lineitem(lambda r: E.sample_households(r, 40, 42)),
    # documented baselines
    "rolling_stats": on_events(lambda r: shown(K.rolling_stats(r), "roll_avg", "roll_std")),
    "zscore": on_events(lambda r: shown(K.zscore(r), "roll_avg", "roll_std", "z")),
    "dynamic_threshold": on_events(lambda r: shown(K.dynamic_threshold(r), "roll_avg", "roll_std")),
    "rule_filter": on_events(lambda r: shown(K.rule_filter(r), "roll_avg", "roll_std")),
    "household_tier": on_events(K.household_tier),
}


# --- household features, labels, split, evaluation (E24-E29, D1-D3, J2, J7-J16, J18) ----


FEATURES_VERSION = "features-2"


def hf_events(spark: SparkSession, d: str) -> DataFrame:
    """Household features of the folder, computed from readings once and reused."""
    key = f"{version_key(spark, d)}|{FEATURES_VERSION}"
    return materialize(spark, "household_features", key, lambda: HF.household_features(_ev(spark, d)))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return HF.label_quantile(hf_events(spark, d))


def split(spark: SparkSession, d: str) -> DataFrame:
    """Labelled features with the exact stratified 80/20 split, materialised once."""
    key = f"{version_key(spark, d)}|{FEATURES_VERSION}|split-0.2-42"
    return materialize(spark, "split", key, lambda: HF.stratified_split(labelled(spark, d)))


def heuristic_scored(spark: SparkSession, d: str) -> DataFrame:
    """Both rule scorers on the test households (stand-ins for fitted models)."""
    test = split(spark, d).where(F.col("is_test") == 1)
    return J.heuristic_scores(test, "spike").unionByName(J.heuristic_scores(test, "night"))


def heuristic_metrics(spark: SparkSession, d: str) -> DataFrame:
    return J.metrics_table(heuristic_scored(spark, d))


def _ensemble(spark: SparkSession, d: str) -> DataFrame:
    sc = heuristic_scored(spark, d)
    return J.ensemble(sc.where(F.col("model") == "spike_rule"), sc.where(F.col("model") == "night_rule"))


QUERIES.update({
    "household_features": on_events(lambda r: HF.features_shown(HF.household_features(r))),
    "household_features_lineitem": on_lineitem(lambda r: HF.features_shown(HF.household_features(r))),
    "household_features_live": on_events(
        lambda r: HF.features_shown(HF.household_features(C.global_filter(r, **FILTER_SPEC), "live"))),
    "label_by_quantile": lambda s, d: HF.features_shown(labelled(s, d)),
    "label_by_rule": lambda s, d: HF.features_shown(HF.label_rule(hf_events(s, d))),
    "label_distribution": lambda s, d: HF.label_distribution(labelled(s, d)),
    "stratified_split": lambda s, d: HF.features_shown(HF.stratified_split(labelled(s, d))),
    "class_weights": lambda s, d: HF.class_weights(split(s, d).where(F.col("is_test") == 0)),
    "classification_metrics": lambda s, d: J.classification_metrics(heuristic_scored(s, d)),
    "confusion_matrix": lambda s, d: J.confusion_matrix(heuristic_scored(s, d)),
    "roc_curve": lambda s, d: shown(J.roc_curve(heuristic_scored(s, d)), "threshold"),
    "auc_roc": lambda s, d: J.auc_roc(heuristic_scored(s, d)),
    "classification_report": lambda s, d: J.classification_report(heuristic_scored(s, d)),
    "model_comparison": lambda s, d: J.model_comparison(heuristic_metrics(s, d), "spike_rule", "night_rule"),
    "comparison_tally": lambda s, d: J.comparison_tally(heuristic_metrics(s, d), "spike_rule", "night_rule"),
    "metrics_summary": lambda s, d: J.metrics_summary(heuristic_metrics(s, d), "spike_rule", "night_rule"),
    "ensemble_verdict": _ensemble,
})


# --- MLlib models (J1, J3-J6, J12, J15, J17, J19, A7, A8, K11) ------------------------------

WHATIF_SCENARIOS = [
    M.Scenario("night_usage_x2", "night_avg_usage", "mul", 2.0),
    M.Scenario("spikes_calm", "max_spike_ratio", "set", 1.0),
    M.Scenario("spikes_calm", "avg_spike_ratio", "set", 1.0),
    M.Scenario("volatile", "std_usage", "mul", 3.0),
]


def _model_key(spark: SparkSession, d: str, kind: str) -> tuple:
    params = M.RF_PARAMS if kind == "rf" else M.GBT_PARAMS
    return (version_key(spark, d), FEATURES_VERSION, "split-0.2-42", kind, tuple(sorted(params.items())))


def fitted(spark: SparkSession, d: str, kind: str) -> M.PipelineModel:
    """Fit on the training split (once per process) and publish to the model registry."""
    key = _model_key(spark, d, kind)

    def build():
        m = M.train(split(spark, d).where(F.col("is_test") == 0), kind)
        M.publish_model(spark, m, stable_path(spark, "models", M.registry_tag(key)))
        return m
    return M.memo_model(key, build)


def model(spark: SparkSession, d: str, kind: str) -> M.PipelineModel:
    """The registered model of this data version: in-process memo, else the saved
    registry entry (what the dashboard loads), else a fresh fit."""
    key = _model_key(spark, d, kind)
    with M._models_lock:  # noqa: SLF001
        if key in M._models:  # noqa: SLF001
            return M._models[key]  # noqa: SLF001
    saved = M.load_model(stable_path(spark, "models", M.registry_tag(key)))
    if saved is not None:
        return M.memo_model(key, lambda: saved)
    return fitted(spark, d, kind)


def models(spark: SparkSession, d: str, anew: bool = False) -> dict[str, M.PipelineModel]:
    """Both registered models, or both fitted, side by side; the split that both read is written first."""
    split(spark, d)
    return M.side_by_side(spark, lambda kind: (fitted if anew else model)(spark, d, kind))


def notebook_split(spark: SparkSession, d: str) -> DataFrame:
    key = f"{version_key(spark, d)}|{FEATURES_VERSION}|notebook-split"
    return materialize(spark, "split_notebook", key,
                       lambda: HF.stratified_split(HF.label_rule(hf_events(spark, d))))


def notebook_model(spark: SparkSession, d: str) -> M.PipelineModel:
    key = (version_key(spark, d), FEATURES_VERSION, "rf_notebook")
    return M.memo_model(key, lambda: M.train(notebook_split(spark, d).where(F.col("is_test") == 0), "rf",
                                             NOTEBOOK_FEATURES))


def test_scores(spark: SparkSession, d: str) -> DataFrame:
    test, fits = split(spark, d).where(F.col("is_test") == 1), models(spark, d)
    return M.score(fits["rf"], test, "rf").unionByName(M.score(fits["gbt"], test, "gbt"))


def all_scores(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return M.score(model(spark, d, kind), split(spark, d), kind)


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a``, and rows that only one of the two frames has."""
    n = a.agg(F.count(F.lit(1)).alias("n_rows"))
    lost = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("n_different"))
    return n.select("n_rows", lost.scalar().alias("n_different"))


def model_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Scores before saving and after loading."""
    path = scratch_path(spark, "models", "rf")
    M.save_model(model(spark, d, "rf"), path)
    return differing(M.score(model(spark, d, "rf"), split(spark, d), "rf"), M.score(M.load_model(path), split(spark, d), "rf"))


def metrics_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Everything the comparison page reads, before saving and after loading."""
    path = scratch_path(spark, "metrics")
    before = comparison(spark, d)
    J.save_metrics(before, path)
    return differing(before, J.load_metrics(spark, path))


def comparison(spark: SparkSession, d: str) -> DataFrame:
    """(model, part, key, value) rows of both models: metrics, ROC points, importances, parameters and sizes."""
    scores = test_scores(spark, d)
    text = lambda part, key, value: [F.lit(part).alias("part"), key.cast("string").alias("key"), value.cast("string").alias("value")]
    rows = J.metrics_table(scores).select("model", *text("metric", F.col("metric"), F.col("value")))
    rows = rows.unionByName(J.roc_curve(scores).select("model", *text(
        "roc", F.col("threshold"), F.concat_ws(" ", F.col("fpr").cast("string"), F.col("tpr").cast("string")))))
    weights = importance(spark, d)
    for kind in ("rf", "gbt"):
        rows = rows.unionByName(weights.select(F.lit(kind).alias("model"), *text("importance", F.col("feature"), F.col(kind))))
    return rows.unionByName(M.model_card(split(spark, d)).select("model", *text("card", F.col("key"), F.col("value"))))


def importance(spark: SparkSession, d: str) -> DataFrame:
    return M.feature_importance(spark, models(spark, d))


def whatif(spark: SparkSession, d: str) -> DataFrame:
    """J17 on the filtered readings, as the prediction page scores them."""
    live = HF.household_features(C.global_filter(_ev(spark, d), **FILTER_SPEC), "live")
    return M.whatif(live, WHATIF_SCENARIOS, models(spark, d))


def scaled(spark: SparkSession, d: str) -> DataFrame:
    data = split(spark, d)
    return M.scale_features(M.fit_scaler(data.where(F.col("is_test") == 0)), data)


# What the tables determine of a model's output, whatever the trees are, and what a model that learned
# nothing fails: SQL can check it. The scores themselves are in the functions above, for jobs and tests.
def _checked(scores: DataFrame, *keys: str) -> DataFrame:
    agrees = F.col("prediction") == (F.col("score") > 0.5).cast("int")
    return scores.select(*(keys or ("model", "household_id", "label")), _unit("score"), agrees.alias("agrees"))


def _fit(model: M.PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    """A model's scores of the test households; ``learned``: it ranks the households it was fitted on (AUC above 0.9)."""
    train, test = (M.score(model, rows.where(F.col("is_test") == i), name) for i in (0, 1))
    learned = J.auc_roc(train).select(F.max("auc") > 0.9).scalar()
    return _checked(test.withColumn("learned", F.coalesce(learned, F.lit(False))), "model", "household_id", "label", "learned")


def _all_scored(spark: SparkSession, d: str) -> DataFrame:
    fits = models(spark, d)
    both = M.score(fits["rf"], split(spark, d), "rf").unionByName(M.score(fits["gbt"], split(spark, d), "gbt"))
    learned = J.auc_roc(both).select("model", (F.col("auc") > 0.9).alias("learned"))
    return _checked(both.join(learned, "model"), "model", "household_id", "label", "learned")


def _varied(df: DataFrame, c: str) -> F.Column:
    """Whether a model's output takes more than one value."""
    return (df.select(F.countDistinct(c)).scalar() > 1).alias("varied")


def _above_chance(metric: F.Column, value: F.Column) -> F.Column:
    """A model that answers alike for all households has an AUC of 0.5."""
    return F.when(metric == "auc_roc", value > 0.6).otherwise(value.between(0, 1))


def _importance(spark: SparkSession, d: str) -> DataFrame:
    rows = importance(spark, d)
    ones = rows.agg(F.struct(*[(F.abs(F.sum(k) - 1) < 1e-6).alias(k) for k in ("rf", "gbt")])).scalar()
    return rows.select("feature", _unit("rf", "rf_in_range"), _unit("gbt", "gbt_in_range"), ones["rf"].alias("rf_whole"),
                       ones["gbt"].alias("gbt_whole"))


def _whatif_checked(spark: SparkSession, d: str) -> DataFrame:
    """``lowers``: without spikes the leak score falls on average."""
    rows = whatif(spark, d)
    mean = rows.groupBy("scenario", "model").agg((F.avg("delta") < 0).alias("_falls"))
    lowers = F.when(F.col("scenario") == "spikes_calm", F.col("_falls")).otherwise(F.lit(True))
    return _checked(rows.join(mean, ["scenario", "model"]).withColumn("lowers", lowers), "scenario", "household_id", "model", "lowers")


def _cross_validated(spark: SparkSession, d: str) -> DataFrame:
    """``learned``: some fold's held-out households are ranked better than by chance."""
    rows = M.cross_validate(labelled(spark, d), scratch_path(spark, "folds"))
    return rows.select("fold", "model", "n", _unit("auc"), (rows.agg(F.max("auc")).scalar() > 0.6).alias("learned"))


def _unit(c: str, out: str = "in_range") -> F.Column:
    return F.col(c).between(0, 1).alias(out)


def _confusion(spark: SparkSession, d: str) -> DataFrame:
    return J.confusion_matrix(test_scores(spark, d)).groupBy("model", "actual").agg(F.sum("n").cast("long").alias("n"))


def _roc_ends(spark: SparkSession, d: str) -> DataFrame:
    return J.roc_curve(test_scores(spark, d)).groupBy("model").agg(
        F.min("fpr").alias("fpr_first"), F.min("tpr").alias("tpr_first"), F.max("fpr").alias("fpr_last"),
        F.max("tpr").alias("tpr_last"), (F.countDistinct("threshold") > 2).alias("turns"))


def _winner(a: str, b: str) -> F.Column:
    return F.when(F.round(a, 4) > F.round(b, 4), a).when(F.round(b, 4) > F.round(a, 4), b).otherwise("Tie")


def _ensemble_ml(spark: SparkSession, d: str) -> DataFrame:
    fits = models(spark, d)
    both = J.ensemble(M.score(fits["rf"], split(spark, d), "rf"), M.score(fits["gbt"], split(spark, d), "gbt"))
    want = F.when(F.col("pred_a") != F.col("pred_b"), "MANUAL REVIEW").when(F.col("pred_a") == 1, "HIGH RISK").otherwise("NORMAL")
    return both.select("household_id", (F.col("verdict") == want).alias("agrees"), _unit("avg_prob"), _varied(both, "avg_prob"))


def _band_model(spark: SparkSession, d: str) -> DataFrame:
    banded = E.probability_band(all_scores(spark, d, "rf"), "score")
    want = F.when(F.col("score") < 0.3, "low").when(F.col("score") < 0.7, "medium").otherwise("high")
    return banded.select("household_id", (F.col("band") == want).alias("agrees"), _varied(banded, "score"))


QUERIES.update({
    "feature_vector": lambda s, d: shown(M.feature_vector(hf_events(s, d)), "value"),
    "legacy_features": lambda s, d: shown(M.legacy_features(hf_events(s, d)), "value"),
    "scale_features": lambda s, d: shown(scaled(s, d), "value"),
    "train_rf": lambda s, d: _fit(fitted(s, d, "rf"), split(s, d), "rf"),
    "train_gbt": lambda s, d: _fit(fitted(s, d, "gbt"), split(s, d), "gbt"),
    "train_rf_notebook": lambda s, d: _fit(notebook_model(s, d), notebook_split(s, d), "rf_notebook"),
    "score_households": _all_scored,
    "model_metrics": lambda s, d: J.metrics_table(test_scores(s, d)).where(F.col("metric").isin(J.METRIC_NAMES)).select(
        "model", "metric", _above_chance(F.col("metric"), F.col("value")).alias("in_range")),
    "model_confusion_matrix": _confusion,
    "model_roc_curve": _roc_ends,
    "model_auc_roc": lambda s, d: J.auc_roc(test_scores(s, d)).select(
        "model", _unit("auc"), (F.col("auc") > 0.6).alias("above_chance")),
    "model_classification_report": lambda s, d: J.classification_report(test_scores(s, d)).select("model", "class", "support"),
    "model_comparison_ml": lambda s, d: J.model_comparison(J.metrics_table(test_scores(s, d)), "rf", "gbt").select(
        "metric", ((F.col("winner_4dp") == _winner("rf", "gbt")) & _above_chance(F.col("metric"), F.col("rf"))
                   & _above_chance(F.col("metric"), F.col("gbt"))).alias("agrees")),
    "metrics_summary_ml": lambda s, d: J.metrics_summary(J.metrics_table(test_scores(s, d)), "rf", "gbt").select(
        "metric", *[F.when(F.col("metric") == "auc_roc", F.col(k) > 0.6).otherwise(F.col(k) >= 0).alias(f"{k}_known")
                    for k in ("rf", "gbt")]),
    "feature_importance": _importance,
    "model_card": lambda s, d: M.model_card(split(s, d)),
    "ensemble_verdict_ml": _ensemble_ml,
    "probability_band_model": _band_model,
    "whatif_score": _whatif_checked,
    "model_roundtrip": model_roundtrip,
    "metrics_roundtrip": lambda s, d: metrics_roundtrip(s, d).select("n_different"),
    "cross_validate": _cross_validated,
})


# --- sources and empty selections (A3, C9) --------------------------------------------------


def _resolve_source(spark: SparkSession, d: str) -> DataFrame:
    """A3: a data folder with a Parquet and a CSV copy resolves to the Parquet one."""
    folder = scratch_path(spark, "data")
    write_readings(_ev(spark, d), f"{folder}/{PARQUET_NAME}")
    export_csv(_ev(spark, d).limit(1), f"{folder}/{CSV_NAME}")
    return load_readings(spark, folder)


def _empty_selection(spark: SparkSession, d: str) -> DataFrame:
    """Whether the example's filter, and one that nothing passes, select no reading."""
    none = FILTER_SPEC | {"min_spike": 1e9}
    frames = {name: C.global_filter(_ev(spark, d), **spec) for name, spec in (("example", FILTER_SPEC), ("none", none))}
    rows = [f.agg((F.count(F.lit(1)) == 0).alias("is_empty")).select(F.lit(n).alias("selection"), "is_empty") for n, f in frames.items()]
    return rows[0].unionByName(rows[1])


QUERIES.update({"resolve_source": _resolve_source, "empty_selection": _empty_selection})


# --- streaming (K12) ----------------------------------------------------------------------


def _stream_rollup(spark: SparkSession, d: str) -> DataFrame:
    base = scratch_path(spark, "stream")
    S.stream_rollup(spark, f"{d}/events.parquet", f"{base}/out", f"{base}/checkpoint")
    return S.read_rollup(spark, f"{base}/out")


QUERIES["stream_hourly_rollup"] = _stream_rollup
