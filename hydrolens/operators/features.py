"""Household features, labels and the train/test split.

``household_features`` is one ``groupBy(household_id)`` with conditional
aggregates (night/day means, event counts): a single shuffle with map-side
partial aggregation, so a meter holding a third of all rows is combined before
the exchange. The join form (D1) is kept only as a cross-check.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolens.functions.columns import shown
from hydrolens.schema import DAY_HOURS, NIGHT_HOURS, RATIO_FLOOR

HH = "household_id"


def _night() -> Column:
    return F.col("hour").between(*NIGHT_HOURS)


def _day_train() -> Column:
    return F.col("hour").between(*DAY_HOURS)


def _day_live() -> Column:
    # dashboard variant: day = not night (differs only for NULL or out-of-range hours)
    return ~F.coalesce(F.col("hour").between(*NIGHT_HOURS), F.lit(False))


def _cond_avg(pred: Column, c: str = "water_usage_liters") -> Column:
    return F.avg(F.when(pred, F.col(c)))


def household_features(r: DataFrame, zero_rule: str = "train") -> DataFrame:
    """E24 (``zero_rule='train'``) and J18 (``'live'``): §1.3 columns, no label.

    train: missing night mean -> 0, missing day mean -> avg_usage, NULL std -> 0,
    ratios divide by max(x, 0.01). live: no night or no day -> ratio 0.0; a
    single reading -> std 0 and cv 0.
    """
    day = _day_train() if zero_rule == "train" else _day_live()
    g = r.groupBy(HH).agg(
        F.avg("water_usage_liters").alias("avg_usage"),
        F.max("water_usage_liters").alias("max_usage"),
        F.stddev_samp("water_usage_liters").alias("std_usage"),
        F.avg("spike_ratio").alias("avg_spike_ratio"),
        F.max("spike_ratio").alias("max_spike_ratio"),
        F.stddev_samp("spike_ratio").alias("std_spike_ratio"),
        F.sum("leak_flag_detected").cast("long").alias("total_leak_events"),
        F.avg("leak_probability").alias("avg_leak_prob"),
        F.count(F.when(F.col("risk_level") == "Critical", 1)).alias("critical_events"),
        F.count(F.when(F.col("risk_level") == "High Risk", 1)).alias("high_risk_events"),
        F.count(F.when(F.col("spike_ratio") > 2, 1)).alias("spike_above_2"),
        F.count(F.lit(1)).alias("total_readings"),
        _cond_avg(_night()).alias("_night"),
        _cond_avg(day).alias("_day"),
    )
    return finish_features(g, zero_rule)


def finish_features(g: DataFrame, zero_rule: str = "train") -> DataFrame:
    floor = F.lit(RATIO_FLOOR)
    if zero_rule == "train":
        g = g.withColumns({
            "night_avg_usage": F.coalesce(F.col("_night"), F.lit(0.0)),
            "day_avg_usage": F.coalesce(F.col("_day"), F.col("avg_usage")),
            "std_usage": F.coalesce(F.col("std_usage"), F.lit(0.0)),
            "std_spike_ratio": F.coalesce(F.col("std_spike_ratio"), F.lit(0.0)),
        })
        g = g.withColumns({
            "night_day_ratio": F.col("night_avg_usage") / F.greatest(F.col("day_avg_usage"), floor),
            "usage_range": F.col("max_usage") - F.col("avg_usage"),
            "cv_usage": F.col("std_usage") / F.greatest(F.col("avg_usage"), floor),
        })
    elif zero_rule == "live":
        single = F.col("total_readings") <= 1
        g = g.withColumns({
            "night_avg_usage": F.coalesce(F.col("_night"), F.lit(0.0)),
            "day_avg_usage": F.coalesce(F.col("_day"), F.col("avg_usage")),
            "std_usage": F.when(single, F.lit(0.0)).otherwise(F.coalesce(F.col("std_usage"), F.lit(0.0))),
            "std_spike_ratio": F.when(single, F.lit(0.0)).otherwise(F.coalesce(F.col("std_spike_ratio"), F.lit(0.0))),
        })
        both = F.col("_night").isNotNull() & F.col("_day").isNotNull()
        g = g.withColumns({
            "night_day_ratio": F.when(both, F.col("_night") / F.greatest(F.col("_day"), floor)).otherwise(F.lit(0.0)),
            "usage_range": F.col("max_usage") - F.col("avg_usage"),
            "cv_usage": F.when(single, F.lit(0.0)).otherwise(F.col("std_usage") / F.greatest(F.col("avg_usage"), floor)),
        })
    else:
        raise ValueError(f"unknown zero rule {zero_rule!r}")
    from hydrolens.schema import HOUSEHOLD_FEATURE_COLUMNS
    return g.select(*HOUSEHOLD_FEATURE_COLUMNS)


def features_shown(hf: DataFrame) -> DataFrame:
    """A finished feature table for display: means, deviations and ratios rounded."""
    return shown(hf, "avg_usage", "std_usage", "avg_spike_ratio", "std_spike_ratio", "avg_leak_prob", "night_avg_usage",
                 "day_avg_usage", "night_day_ratio", "usage_range", "cv_usage")


# --- labels (D3, E26-E28) ------------------------------------------------------
def label_quantile(hf: DataFrame, q: float = 0.75) -> DataFrame:
    """1 if avg_leak_prob >= its q-quantile (linear); if that yields one
    class, use the median with '>'; if still one class, fail with a clear error.

    The thresholds come from the exact narrowing: one row of five numbers is fetched
    while the query is built, since every later use of the label (split, weights, fits)
    would otherwise carry the search for them in its plan. '>= q-quantile' has a 0
    class iff some value is below it or NULL, and '> median' has a 1 class iff the max
    exceeds the median. The features, a row a household, are read several times, so
    they are kept (memory, then disk) once computed.
    """
    from hydrolens.operators.quantiles import quantile_columns
    p, hf = F.col("avg_leak_prob"), hf.cache()
    at = quantile_columns(hf, "avg_leak_prob", [q, 0.5, 0.0, 1.0], ["q", "m", "lo", "hi"]).first()
    single = F.raise_error(F.lit("label_quantile: avg_leak_prob gives a single class")).cast("int")
    if at is None or at.q is None:  # no probability at all: a single (0) class
        return hf.withColumn("is_high_risk", single)
    if at.lo < at.q or hf.where(p.isNull()).limit(1).count():
        return hf.withColumn("is_high_risk", F.coalesce((p >= at.q).cast("int"), F.lit(0)))
    if at.hi > at.m:
        return hf.withColumn("is_high_risk", F.coalesce((p > at.m).cast("int"), F.lit(0)))
    return hf.withColumn("is_high_risk", single)


def label_rule(hf: DataFrame, events: int = 20) -> DataFrame:
    """Notebook label = more than ``events`` leak events or any critical event."""
    return hf.withColumn("is_high_risk",
                         ((F.col("total_leak_events") > events) | (F.col("critical_events") > 0)).cast("int"))


def label_distribution(hf: DataFrame, label: str = "is_high_risk") -> DataFrame:
    """Class counts and percent."""
    g = hf.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))


def class_weights(train: DataFrame, label: str = "is_high_risk") -> DataFrame:
    """negatives/positives on the training rows, 1.0 if there is no positive."""
    g = train.agg(F.count(F.when(F.col(label) == 0, 1)).alias("n_neg"),
                  F.count(F.when(F.col(label) == 1, 1)).alias("n_pos"))
    return g.withColumn("ratio", F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).otherwise(F.lit(1.0)))


# --- stratified split (J2) -------------------------------------------------------
SPLIT_BUCKET_HEX = 4  # 16^4 = 65,536 hash buckets per class


def stratified_split(hf: DataFrame, test: float = 0.2, seed: int = 42, label: str = "is_high_risk",
                     key: str = HH) -> DataFrame:
    """Exact stratified split. Per class, the round(test * n_class) rows with
    the smallest md5(id:seed) form the test set.

    A rank window per class would put every household of a class in one task.
    Instead (two light passes): count rows per (class, hash bucket) — at most
    65,536 buckets per class — locate the bucket holding the cut, and rank only
    the rows of that one bucket. Everything else is decided by its bucket.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    x = hf.withColumns({"_h": h, "_b": F.conv(F.substring(h, 1, SPLIT_BUCKET_HEX), 16, 10).cast("int")})
    per_b = x.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    wcum = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_b = per_b.withColumns({"_cum": F.sum("_nb").over(wcum),
                               "_tot": F.sum("_nb").over(Window.partitionBy(label))})
    per_b = per_b.withColumn("_k", F.floor(F.lit(test) * F.col("_tot") + F.lit(0.5)))
    cut = (per_b.where((F.col("_cum") - F.col("_nb") < F.col("_k")) & (F.col("_cum") >= F.col("_k")))
                .select(label, F.col("_b").alias("_bstar"), (F.col("_k") - (F.col("_cum") - F.col("_nb"))).alias("_need")))
    # one row per class value: bounded by the label vocabulary
    y = x.join(F.broadcast(cut), label, "left")
    in_star = y.where(F.col("_b") == F.col("_bstar"))
    rest = y.where(F.col("_bstar").isNull() | (F.col("_b") != F.col("_bstar")))
    rk = F.row_number().over(Window.partitionBy(label).orderBy("_h", key))
    in_star = in_star.withColumn("is_test", (rk <= F.col("_need")).cast("int"))
    rest = rest.withColumn("is_test", F.coalesce((F.col("_b") < F.col("_bstar")).cast("int"), F.lit(0)))
    return in_star.unionByName(rest).select(*hf.columns, "is_test")
