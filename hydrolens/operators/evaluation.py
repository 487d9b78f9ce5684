"""Classifier evaluation over scored rows.

Input ``sc``: household_id, label, score, prediction, model. Every metric is an
aggregate of integer confusion counts per model, so it is exact and identical
in any engine. The ROC curve pre-aggregates by (model, score), then takes its
running sums as a prefix scan over ranges of scores: totals by range, sums of the
ranges above, and a running sum inside each fine range. A model's scores, however
many, are spread over as many tasks as there are ranges.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolens.functions.columns import r6
from hydrolens.functions.order import leading, order_key
from hydrolens.schema import CLASS_NAMES

METRIC_NAMES = ["accuracy", "precision", "recall", "f1", "auc_roc"]


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def confusion_counts(sc: DataFrame) -> DataFrame:
    lab, pred = F.col("label"), F.col("prediction")
    return sc.groupBy("model").agg(
        F.count(F.when((lab == 1) & (pred == 1), 1)).alias("tp"),
        F.count(F.when((lab == 0) & (pred == 1), 1)).alias("fp"),
        F.count(F.when((lab == 1) & (pred == 0), 1)).alias("fn"),
        F.count(F.when((lab == 0) & (pred == 0), 1)).alias("tn"))


def _metric_cols() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {"accuracy": _div(tp + tn, tp + fp + fn + tn), "precision": _div(tp, tp + fp),
            "recall": _div(tp, tp + fn), "f1": _div(2 * tp, 2 * tp + fp + fn)}


def classification_metrics(sc: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 on zero division), long format."""
    c = confusion_counts(sc).withColumns(_metric_cols())
    return c.selectExpr("model", "stack(4, 'accuracy', accuracy, 'precision', precision, 'recall', recall, "
                        "'f1', f1) as (metric, value)")


def confusion_matrix(sc: DataFrame) -> DataFrame:
    """All four (actual, predicted) cells per model, zero cells included."""
    c = confusion_counts(sc)
    return c.selectExpr("model", "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (actual, predicted, n)")


def _score_groups(sc: DataFrame) -> DataFrame:
    return sc.groupBy("model", "score").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") == 0, 1)).alias("neg"))


#: Binary digits of a score's order key that name a range, and a fine range inside it.
RANGE, FINE = 16, 36


def _above(g: DataFrame) -> DataFrame:
    """Score groups with the positives and negatives of their model that score higher (``_pa``, ``_na``), and all (``_pos``, ``_neg``).

    Ranges of ``order_key`` don't depend on the data: a model has at most 65,538 of
    them, a range at most 1,048,576 fine ones, and a fine range scores that differ by
    4e-8 of their size at most. These bound each window below.
    """
    key = order_key(F.col("score").cast("double"))
    g = g.withColumns({"_range": leading(key, RANGE), "_fine": leading(key, FINE)})
    fine = g.groupBy("model", "_range", "_fine").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    ranges = fine.groupBy("model", "_range").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))

    def before(of: DataFrame, own: list[str], by: str, p: str, n: str, out: str) -> DataFrame:
        w = Window.partitionBy(*own).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
        return of.withColumns({f"_p{out}": F.coalesce(F.sum(p).over(w), F.lit(0)),
                               f"_n{out}": F.coalesce(F.sum(n).over(w), F.lit(0))})

    every = Window.partitionBy("model")
    ranges = before(ranges, ["model"], "_range", "p", "n", "1").withColumns(
        {"_pos": F.sum("p").over(every), "_neg": F.sum("n").over(every)}).drop("p", "n")
    fine = before(fine, ["model", "_range"], "_fine", "p", "n", "2").drop("p", "n")
    fine = fine.join(ranges, ["model", "_range"])
    out = before(g.join(fine, ["model", "_range", "_fine"]), ["model", "_range", "_fine"], "score", "pos", "neg", "3")
    total = lambda c: F.col(f"_{c}1") + F.col(f"_{c}2") + F.col(f"_{c}3")
    return out.select("model", "score", "pos", "neg", total("p").alias("_pa"), total("n").alias("_na"), "_pos", "_neg")


def roc_curve(sc: DataFrame) -> DataFrame:
    """(fpr, tpr) at every distinct score (score >= threshold is positive), plus the origin."""
    g = _above(_score_groups(sc))
    pts = g.select("model", F.col("score").alias("threshold"), _div(F.col("_na") + F.col("neg"), F.col("_neg")).alias("fpr"),
                   _div(F.col("_pa") + F.col("pos"), F.col("_pos")).alias("tpr"))
    origin = sc.select("model").distinct().select("model", F.lit(float("inf")).alias("threshold"),
                                                  F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts)


def auc_roc(sc: DataFrame) -> DataFrame:
    """Trapezoid area under the ROC curve from integer areas; 0.0 with one class.

    Per score group the area is neg * (positives ranked above + pos / 2), so
    2 * AUC * P * N = sum(neg * (2 * positives above + pos)): exact in integers.
    """
    g = _above(_score_groups(sc))
    twice = F.col("neg").cast("decimal(19,0)") * (2 * F.col("_pa") + F.col("pos")).cast("decimal(19,0)")
    a = g.groupBy("model").agg(F.sum(twice).cast("double").alias("twice"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return a.select("model", F.when((F.col("P") > 0) & (F.col("N") > 0),
                                    F.col("twice") / (2.0 * F.col("P") * F.col("N"))).otherwise(F.lit(0.0)).alias("auc"))


def classification_report(sc: DataFrame) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted averages."""
    c = confusion_counts(sc)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.withColumns({
        "p1": _div(tp, tp + fp), "r1": _div(tp, tp + fn), "f1_1": _div(2 * tp, 2 * tp + fp + fn), "s1": tp + fn,
        "p0": _div(tn, tn + fn), "r0": _div(tn, tn + fp), "f1_0": _div(2 * tn, 2 * tn + fn + fp), "s0": tn + fp,
        "acc": _div(tp + tn, tp + fp + fn + tn), "n": tp + fp + fn + tn})
    c = c.withColumns({
        "mp": (F.col("p0") + F.col("p1")) / 2, "mr": (F.col("r0") + F.col("r1")) / 2,
        "mf": (F.col("f1_0") + F.col("f1_1")) / 2,
        "wp": _div(F.col("p0") * F.col("s0") + F.col("p1") * F.col("s1"), F.col("n")),
        "wr": _div(F.col("r0") * F.col("s0") + F.col("r1") * F.col("s1"), F.col("n")),
        "wf": _div(F.col("f1_0") * F.col("s0") + F.col("f1_1") * F.col("s1"), F.col("n"))})
    return c.selectExpr("model", f"""stack(5,
        '{CLASS_NAMES[0]}', p0, r0, f1_0, s0,
        '{CLASS_NAMES[1]}', p1, r1, f1_1, s1,
        'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), acc, n,
        'macro avg', mp, mr, mf, n,
        'weighted avg', wp, wr, wf, n) as (class, precision, recall, f1, support)""")


def metrics_table(sc: DataFrame) -> DataFrame:
    """Long (model, metric, value) table of the five comparison metrics plus TN/FP/FN/TP."""
    m = classification_metrics(sc).unionByName(
        auc_roc(sc).select("model", F.lit("auc_roc").alias("metric"), F.col("auc").alias("value")))
    cm = confusion_counts(sc).selectExpr(
        "model", "stack(4, 'TN', CAST(tn AS DOUBLE), 'FP', CAST(fp AS DOUBLE), 'FN', CAST(fn AS DOUBLE), "
        "'TP', CAST(tp AS DOUBLE)) as (metric, value)")
    return m.unionByName(cm)


def _side_by_side(metrics: DataFrame, a: str, b: str) -> DataFrame:
    return metrics.groupBy("metric").agg(F.max(F.when(F.col("model") == a, F.col("value"))).alias("a"),
                                         F.max(F.when(F.col("model") == b, F.col("value"))).alias("b"))


def model_comparison(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """Five metrics side by side with the winner by raw value (cards) and by
    4-decimal value (table); 'Tie' when equal."""
    s = _side_by_side(metrics, a, b).where(F.col("metric").isin(METRIC_NAMES))
    ra, rb = F.round(F.col("a"), 4), F.round(F.col("b"), 4)
    return s.select(
        "metric", F.col("a").alias(a), F.col("b").alias(b),
        F.when(F.col("a") > F.col("b"), a).when(F.col("b") > F.col("a"), b).otherwise("Tie").alias("winner_raw"),
        F.when(ra > rb, a).when(rb > ra, b).otherwise("Tie").alias("winner_4dp"))


def comparison_tally(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """Wins per model and ties over the five metrics (raw-value rule)."""
    c = model_comparison(metrics, a, b)
    return c.agg(F.count(F.when(F.col("winner_raw") == a, 1)).alias(f"{a}_wins"),
                 F.count(F.when(F.col("winner_raw") == b, 1)).alias(f"{b}_wins"),
                 F.count(F.when(F.col("winner_raw") == "Tie", 1)).alias("ties"))


def metrics_summary(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """Nine rows (five metrics + TN, FP, FN, TP); winner only for the five."""
    s = _side_by_side(metrics, a, b)
    ra, rb = F.round(F.col("a"), 4), F.round(F.col("b"), 4)
    win = (F.when(~F.col("metric").isin(METRIC_NAMES), F.lit(None).cast("string"))
            .when(ra > rb, a).when(rb > ra, b).otherwise("Tie"))
    return s.select("metric", r6(F.col("a")).alias(a), r6(F.col("b")).alias(b), win.alias("winner"))


def ensemble(sc_a: DataFrame, sc_b: DataFrame) -> DataFrame:
    """Agree -> class and mean probability; disagree -> manual review.

    Both inputs hold one row per household; the join is on the household key.
    """
    a = sc_a.select("household_id", F.col("prediction").alias("pred_a"), F.col("score").alias("score_a"))
    b = sc_b.select("household_id", F.col("prediction").alias("pred_b"), F.col("score").alias("score_b"))
    j = a.join(b, "household_id")
    return j.select("household_id", "pred_a", "pred_b",
                    r6((F.col("score_a") + F.col("score_b")) / 2).alias("avg_prob"),
                    F.when((F.col("pred_a") == 1) & (F.col("pred_b") == 1), "HIGH RISK")
                     .when((F.col("pred_a") == 0) & (F.col("pred_b") == 0), "NORMAL")
                     .otherwise("MANUAL REVIEW").alias("verdict"))


# --- heuristic scorers: exact, SQL-comparable stand-ins for a fitted model ----------
def heuristic_scores(hf: DataFrame, kind: str = "spike", label: str = "is_high_risk") -> DataFrame:
    """Rule scores on household features, for testing the evaluation operators.

    spike: min(max_spike_ratio / 10, 1); night: min(night_day_ratio, 1).
    Prediction = score > 0.5.
    """
    if kind == "spike":
        s = F.least(F.col("max_spike_ratio") / 10, F.lit(1.0))
    elif kind == "night":
        s = F.least(F.col("night_day_ratio"), F.lit(1.0))
    else:
        raise ValueError(kind)
    return hf.select("household_id", F.col(label).alias("label"), s.alias("score")).withColumns(
        {"prediction": (F.col("score") > 0.5).cast("int"), "model": F.lit(f"{kind}_rule")})


def save_metrics(metrics: DataFrame, path: str) -> None:
    """The long (model, metric, value) table as Parquet (distributed write)."""
    metrics.write.mode("overwrite").parquet(path)


def load_metrics(spark, path: str) -> DataFrame | None:
    """Read saved metrics; None when missing or unreadable (the dashboard then warns)."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
