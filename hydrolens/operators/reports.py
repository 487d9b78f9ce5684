"""Dashboard aggregations, rankings and samples.

Each operator is ``readings -> DataFrame`` and stays lazy. Per-household
statistics are two-level: a household aggregate (partial + final, so a hot
meter is combined map-side) and then a tiny global aggregate over households.
Top-k queries carry an explicit tie-break so results are deterministic.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolens.functions.columns import (
    anomaly_band as anomaly_band_col, date_of, first_label, label_rank, last_label, methodology_spike_band, month_of, probability_band as probability_band_col, r6, risk_rank, safe_pct, severity_rank, shown, spike_bin_ord, weekday_name, weekday_number, weekday_of_number,
)
from hydrolens.schema import (
    RISK_CARD_CLASS, RISK_LABELS, SEVERITY_LABELS, SPIKE_BIN_LABELS,
)

HIGH_TIERS = ["High Risk", "Critical"]


# --- projections (B1-B15) ---------------------------------------------------------
def with_calendar(r: DataFrame) -> DataFrame:
    """Date, YYYY-MM month, English weekday name."""
    return r.withColumns({"date": date_of("timestamp"), "month": month_of("timestamp"),
                          "day_of_week": weekday_name("timestamp")})


def with_ordinals(r: DataFrame) -> DataFrame:
    """Label -> business-order integer, NULL if the label is unknown."""
    return r.withColumns({"sev_order": severity_rank("leak_severity"), "risk_order": risk_rank("risk_level")})


def project(r: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Projection to a chosen column list, names validated first."""
    missing = [c for c in cols if c not in r.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    return r.select(*cols)


def anomaly_band(r: DataFrame) -> DataFrame:
    """Normal / Spike > 2 / Spike > 3 per reading (strict thresholds)."""
    return r.select("household_id", "timestamp", "water_usage_liters", "spike_ratio", "risk_level",
                    anomaly_band_col("spike_ratio").alias("anomaly"))


def spike_band(r: DataFrame) -> DataFrame:
    """Methodology bands of the spike ratio."""
    return r.withColumn("band", methodology_spike_band("spike_ratio"))


def probability_band(df: DataFrame, c: str = "leak_probability") -> DataFrame:
    """Low < 0.3 <= medium < 0.7 <= high."""
    return df.withColumn("band", probability_band_col(c))


def dataset_info(r: DataFrame) -> DataFrame:
    """Row count and first/last date."""
    return r.agg(F.count(F.lit(1)).alias("n_records"), F.to_date(F.min("timestamp")).alias("min_date"),
                 F.to_date(F.max("timestamp")).alias("max_date"))


# --- overview (E1-E9) ---------------------------------------------------------------
def overview_kpis(r: DataFrame) -> DataFrame:
    """E1 in two levels: per household, then over households (no multi-distinct Expand)."""
    per_hh = r.groupBy("household_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("leak_flag_detected").alias("leaks"),
        F.sum("water_usage_liters").alias("su"), F.count("water_usage_liters").alias("cu"),
        F.sum("spike_ratio").alias("ss"), F.count("spike_ratio").alias("cs"),
        F.max(F.col("risk_level").isin(HIGH_TIERS).cast("int")).alias("hr"),
        F.max((F.col("risk_level") == "Critical").cast("int")).alias("cr"))
    n = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    leaks = F.coalesce(F.sum("leaks"), F.lit(0)).cast("long")
    return per_hh.agg(
        n.alias("n_records"), F.count(F.lit(1)).alias("n_households"),
        r6(F.sum("su") / F.sum("cu")).alias("avg_usage"),
        leaks.alias("n_leaks"), safe_pct(leaks, n).alias("leak_pct"),
        F.count(F.when(F.col("hr") == 1, 1)).alias("n_high_risk"),
        F.count(F.when(F.col("cr") == 1, 1)).alias("n_critical"),
        r6(F.sum("ss") / F.sum("cs")).alias("avg_spike"))


def distribution(r: DataFrame, c: str, order: Sequence[str] | None = None,
                 with_households: bool = False) -> DataFrame:
    """Records per label. With ``order`` only known labels are kept
    (business order); otherwise every non-null label, most frequent first."""
    x = r.where(F.col(c).isNotNull())
    if order is not None:
        x = x.where(F.col(c).isin(list(order)))
    aggs = [F.count(F.lit(1)).alias("n_records")]
    if with_households:
        aggs.append(F.countDistinct("household_id").alias("n_households"))
    out = x.groupBy(F.col(c).alias("label")).agg(*aggs)
    if order is not None:
        return out.orderBy(label_rank("label", order))
    return out.orderBy(F.desc("n_records"), "label")


def risk_distribution(r: DataFrame) -> DataFrame:
    return distribution(r, "risk_level")


def risk_distribution_ordered(r: DataFrame) -> DataFrame:
    return distribution(r, "risk_level", RISK_LABELS, with_households=True)


def severity_distribution(r: DataFrame) -> DataFrame:
    return distribution(r, "leak_severity", SEVERITY_LABELS)


def share(r: DataFrame, c: str, order: Sequence[str] | None = None) -> DataFrame:
    """Percent of total per known label (pie charts); total window runs on <= 5 rows.
    ``order`` defaults to the column's vocabulary."""
    order = order or {"leak_severity": SEVERITY_LABELS, "risk_level": RISK_LABELS}[c]
    d = distribution(r, c, order)
    return d.withColumn("pct", F.lit(100.0) * F.col("n_records") / F.sum("n_records").over(Window.partitionBy()))


def severity_share(r: DataFrame) -> DataFrame:
    return share(r, "leak_severity", SEVERITY_LABELS)


def risk_share(r: DataFrame) -> DataFrame:
    return share(r, "risk_level", RISK_LABELS)


def spike_histogram(r: DataFrame) -> DataFrame:
    """Five right-closed bins, every bin present (zero bins too). One pass:
    five conditional counts, then unpivoted with ``stack``."""
    b = spike_bin_ord("spike_ratio")
    counts = r.agg(*[F.count(F.when(b == i, 1)).alias(f"c{i}") for i in range(len(SPIKE_BIN_LABELS))])
    args = ", ".join(f"'{lab}', {i}, c{i}" for i, lab in enumerate(SPIKE_BIN_LABELS))
    return counts.selectExpr(f"stack({len(SPIKE_BIN_LABELS)}, {args}) as (bucket, ord, n_records)")


def daily_count(r: DataFrame, predicate: Column) -> DataFrame:
    """Rows per date satisfying a predicate."""
    return r.where(predicate).groupBy(date_of("timestamp").alias("date")).agg(F.count(F.lit(1)).alias("n"))


def daily_leaks(r: DataFrame) -> DataFrame:
    return daily_count(r, F.col("leak_flag_detected") == 1)


def daily_spikes_2(r: DataFrame) -> DataFrame:
    return daily_count(r, F.col("spike_ratio") > 2)


def daily_spikes_3(r: DataFrame) -> DataFrame:
    return daily_count(r, F.col("spike_ratio") > 3)


def severity_by_month(r: DataFrame) -> DataFrame:
    """Non-Normal records per (month, severity), observed pairs only."""
    x = r.where(F.col("leak_severity").isNotNull() & (F.col("leak_severity") != "Normal"))
    # grouped on a date, and named by month once a group
    n = x.groupBy(F.date_trunc("month", "timestamp").cast("date").alias("_m"), "leak_severity").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.date_format("_m", "yyyy-MM").alias("month"), "leak_severity", "n")


def usage_by_severity(r: DataFrame) -> DataFrame:
    """Mean usage per known severity."""
    x = r.where(F.col("leak_severity").isin(SEVERITY_LABELS))
    return (x.groupBy("leak_severity").agg(r6(F.avg("water_usage_liters")).alias("avg_usage"))
             .orderBy(severity_rank("leak_severity")))


# --- household rankings (E10, E11, E22, E23, E31-E33, F1, F2) ----------------------
def top_high_risk(r: DataFrame, n: int = 20, fmt: bool = False) -> DataFrame:
    """Households with High Risk/Critical rows, ranked by mean probability of those rows.
    ``fmt=True`` returns the formatted, renamed display table (B7/B11)."""
    if fmt:
        return top_high_risk_display(r, n)
    return shown(_top_high_risk(r, n), "avg_leak_prob", "avg_spike", "avg_usage")


def _top_high_risk(r: DataFrame, n: int) -> DataFrame:
    x = r.where(F.col("risk_level").isin(HIGH_TIERS))
    g = x.groupBy("household_id").agg(
        first_label("risk_level").alias("risk_level"),
        F.avg("leak_probability").alias("avg_leak_prob"),
        F.avg("spike_ratio").alias("avg_spike"),
        F.sum("leak_flag_detected").cast("long").alias("leak_events"),
        F.avg("water_usage_liters").alias("avg_usage"))
    return g.orderBy(F.desc("avg_leak_prob"), "household_id").limit(n)


def _fixed(c: str | Column, digits: int) -> Column:
    """Text with ``digits`` decimals, ties to the even digit (of the number's shortest decimal form)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.bround(c, digits).cast(f"decimal(38,{digits})").cast("string")


def top_high_risk_display(r: DataFrame, n: int = 20) -> DataFrame:
    """The ranked table formatted and renamed for display."""
    t = _top_high_risk(r, n)
    return t.select(
        F.col("household_id").alias("Household"), F.col("risk_level").alias("Risk"),
        _fixed("avg_leak_prob", 4).alias("Leak Probability"), _fixed("avg_spike", 2).alias("Avg Spike Ratio"),
        F.col("leak_events").alias("Leak Events"),
        F.concat(_fixed("avg_usage", 1), F.lit(" L")).alias("Avg Usage"))


def household_summary(r: DataFrame, pattern: str = "", n: int = 100) -> DataFrame:
    """Per household first risk level, modal severity (smallest label on ties),
    mean probability and spike, leak events; top ``n`` by mean probability.

    Two levels: (household, severity) counts and sums first, then per household
    the mode is the label with the largest count. Any label counts, also one
    outside the vocabularies.
    """
    return shown(_household_summary(r, pattern, n), "avg_leak_prob", "avg_spike")


def _household_summary(r: DataFrame, pattern: str, n: int) -> DataFrame:
    from hydrolens.operators.filters import household_search
    x = household_search(r, pattern)
    lvl1 = x.groupBy("household_id", "leak_severity").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("leak_probability").alias("_sp"), F.count("leak_probability").alias("_cp"),
        F.sum("spike_ratio").alias("_ss"), F.count("spike_ratio").alias("_cs"),
        F.sum("leak_flag_detected").alias("_lf"),
        # earliest non-missing risk level of the group ("first" skips missing values)
        F.min(F.when(F.col("risk_level").isNotNull(), F.col("timestamp"))).alias("_t0"),
        first_label("risk_level").alias("_r0"))
    often = F.when(F.col("leak_severity").isNotNull(), F.struct(-F.col("_n"), F.col("leak_severity")))
    g = lvl1.groupBy("household_id").agg(
        F.min_by("_r0", "_t0").alias("risk_level"), F.min_by("leak_severity", often).alias("leak_severity"),
        (F.sum("_sp") / F.sum("_cp")).alias("_p"), (F.sum("_ss") / F.sum("_cs")).alias("_s"),
        F.sum("_lf").cast("long").alias("leak_events"))
    out = g.select("household_id", "risk_level", "leak_severity", F.col("_p").alias("avg_leak_prob"),
                   F.col("_s").alias("avg_spike"), "leak_events")
    return out.orderBy(F.desc("avg_leak_prob"), "household_id").limit(n)


def household_summary_display(r: DataFrame, pattern: str = "", n: int = 100) -> DataFrame:
    """B11 on E11: the search table with 4- and 2-decimal text columns."""
    t = _household_summary(r, pattern, n)
    return t.select("household_id", "risk_level", "leak_severity", _fixed("avg_leak_prob", 4).alias("avg_leak_prob"),
                    _fixed("avg_spike", 2).alias("avg_spike"), "leak_events")


def household_kpi(r: DataFrame) -> DataFrame:
    """Explorer KPIs for every household at once (last risk by time)."""
    g = r.groupBy("household_id").agg(
        last_label("risk_level").alias("risk_level"),
        F.avg("leak_probability").alias("avg_leak_prob"),
        F.sum("leak_flag_detected").cast("long").alias("leak_events"),
        F.avg("water_usage_liters").alias("avg_usage"),
        F.max("spike_ratio").alias("max_spike"))
    cls = F.create_map(*[x for k, v in RISK_CARD_CLASS.items() for x in (F.lit(k), F.lit(v))])
    g = g.withColumns({
        "risk_status": F.coalesce(cls[F.col("risk_level")], F.lit("")),
        "prob_status": F.when(F.col("avg_leak_prob") > 0.1, "danger").otherwise(""),
        "leak_status": F.when(F.col("leak_events") > 0, "danger").otherwise("success"),
        "spike_status": F.when(F.col("max_spike") > 3, "danger").when(F.col("max_spike") > 2, "warning").otherwise(""),
    })
    return shown(g, "avg_leak_prob", "avg_usage")


def household_severity(r: DataFrame) -> DataFrame:
    """Records per (household, severity) and the share inside the household."""
    g = r.where(F.col("leak_severity").isNotNull()).groupBy("household_id", "leak_severity").agg(
        F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("household_id")))


def top_households(r: DataFrame, value: Column, n: int) -> DataFrame:
    """N largest per-household values, smaller id first on ties."""
    g = r.groupBy("household_id").agg(value.alias("value"))
    return g.where(F.col("value").isNotNull()).orderBy(F.desc("value"), "household_id").limit(n)


def top10_leak_events(r: DataFrame) -> DataFrame:
    return top_households(r, F.sum("leak_flag_detected").cast("long"), 10)


def top5_leak_events(r: DataFrame) -> DataFrame:
    return top_households(r, F.sum("leak_flag_detected").cast("long"), 5)


def top10_avg_spike(r: DataFrame) -> DataFrame:
    return shown(top_households(r, F.avg("spike_ratio"), 10), "value")


# --- consumption behaviour (E12-E18) ---------------------------------------------
def hourly_profile(r: DataFrame) -> DataFrame:
    """Mean usage per hour; rows without an hour belong to none."""
    x = r.where(F.col("hour").isNotNull())
    return x.groupBy("hour").agg(r6(F.avg("water_usage_liters")).alias("avg_usage")).orderBy("hour")


def peak_hours(r: DataFrame) -> DataFrame:
    """Hour of max and min mean usage (smallest hour on ties); one row."""
    h = r.where(F.col("hour").isNotNull()).groupBy("hour").agg(
        F.avg("water_usage_liters").alias("a")).where(F.col("a").isNotNull())
    picked = h.agg(
        F.max_by("hour", F.struct(F.col("a"), -F.col("hour"))).alias("peak_hour"),
        F.max("a").alias("peak_avg"),
        F.min_by("hour", F.struct(F.col("a"), F.col("hour"))).alias("low_hour"),
        F.min("a").alias("low_avg"))
    return shown(picked, "peak_avg", "low_avg")


def usage_histogram(r: DataFrame, bins: int = 60) -> DataFrame:
    """``bins`` equal-width bins of usage; the max falls in the last bin;
    empty bins are kept with 0. Min and max enter as scalar subqueries, the
    per-bin counts (at most ``bins`` rows) are joined to the bin ids."""
    u = r.where(F.col("water_usage_liters").isNotNull())
    # one scalar subquery (a single scan) carries min, max and the row count
    st = u.select(F.struct(F.min("water_usage_liters").alias("mn"), F.max("water_usage_liters").alias("mx"),
                           F.count(F.lit(1)).alias("n"))).scalar()
    mn, mx = st["mn"], st["mx"]
    width = (mx - mn) / F.lit(bins)
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("water_usage_liters") - mn) / width), F.lit(bins - 1))).cast("long")
    counts = u.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark = r.sparkSession
    ids = spark.range(bins).withColumnRenamed("id", "bin")
    out = ids.join(F.broadcast(counts), "bin", "left")  # counts has <= bins rows
    has_rows = st["n"] > 0
    return out.where(has_rows).select(
        "bin", r6(mn + F.col("bin") * width).alias("lo"), r6(mn + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def weekday_profile(r: DataFrame) -> DataFrame:
    """Mean usage per weekday, grouped on its number and named afterwards."""
    x = r.where(F.col("timestamp").isNotNull()).groupBy(weekday_number("timestamp").alias("_d"))
    return x.agg(r6(F.avg("water_usage_liters")).alias("avg_usage")).orderBy("_d").select(
        weekday_of_number("_d").alias("day_of_week"), "avg_usage")


def usage_box(r: DataFrame, approx: bool = False) -> DataFrame:
    """Quartiles (linear), 1.5 IQR whiskers and outlier count per risk level.

    Quartiles come from the narrowing in ``operators.quantiles`` (bounded memory
    per task at any scale; ``approx=True`` uses ``percentile_approx``). The <= 4-row
    quartile table (bounded by the risk vocabulary) is broadcast back to the
    readings for the whisker pass.
    """
    from hydrolens.operators.quantiles import quantile_columns
    x = r.where(F.col("risk_level").isin(RISK_LABELS) & F.col("water_usage_liters").isNotNull())
    if approx:
        q = x.groupBy("risk_level").agg(
            F.percentile_approx("water_usage_liters", [0.25, 0.5, 0.75], 10000).alias("_q")).select(
            "risk_level", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    else:
        q = quantile_columns(x, "water_usage_liters", [0.25, 0.5, 0.75], ["q1", "median", "q3"], ["risk_level"],
                             few_groups=True)
    q = q.withColumns({"_lo": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                       "_hi": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    y = x.join(F.broadcast(q), "risk_level")
    u = F.col("water_usage_liters")
    inside = (u >= F.col("_lo")) & (u <= F.col("_hi"))
    # quartiles ride along as group keys (functionally dependent on the level): computed once
    w = y.groupBy("risk_level", "q1", "median", "q3").agg(
        F.min(F.when(inside, u)).alias("whisker_lo"), F.max(F.when(inside, u)).alias("whisker_hi"),
        F.count(F.when(~inside, 1)).alias("n_outliers"))
    return shown(w, "q1", "median", "q3").orderBy(risk_rank("risk_level"))


def heatmap(r: DataFrame, wide: bool = False) -> DataFrame:
    """Mean usage per (weekday, hour); wide = weekday x h00..h23 (NULL = empty cell).

    The wide form first aggregates to (weekday, hour) cells (2 aggregates per
    reading, partial before the shuffle), then pivots the <= 168 cells with
    conditional picks: per-row cost does not grow with the 24 output columns.
    """
    x = r.where(F.col("timestamp").isNotNull() & F.col("hour").isNotNull())
    cells = x.groupBy(weekday_number("timestamp").alias("_d"), "hour").agg(r6(F.avg("water_usage_liters")).alias("avg_usage"))
    name = weekday_of_number("_d").alias("day_of_week")
    if not wide:
        return cells.select(name, "hour", "avg_usage")
    aggs = [F.max(F.when(F.col("hour") == h, F.col("avg_usage"))).alias(f"h{h:02d}") for h in range(24)]
    days = cells.groupBy("_d").agg(*aggs).orderBy("_d")
    return days.select(name, *[c for c in days.columns if c != "_d"])


# --- anomalies (E19-E21, F3, F6) ----------------------------------------------------
def anomaly_counts(r: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    c2 = F.count(F.when(F.col("spike_ratio") > 2, 1))
    c3 = F.count(F.when(F.col("spike_ratio") > 3, 1))
    return r.agg(c2.alias("n_gt2"), safe_pct(c2, n).alias("pct_gt2"),
                 c3.alias("n_gt3"), safe_pct(c3, n).alias("pct_gt3"))


def worst_spike(r: DataFrame) -> DataFrame:
    """The max spike and its household (earliest, then smallest id on ties)."""
    return (r.where(F.col("spike_ratio").isNotNull()).select("household_id", "timestamp", "spike_ratio")
             .orderBy(F.desc("spike_ratio"), "timestamp", "household_id").limit(1))


def anomaly_table(r: DataFrame, n: int = 200) -> DataFrame:
    """readings with spike > 2, highest first."""
    return (r.where(F.col("spike_ratio") > 2)
             .select("household_id", "timestamp", "water_usage_liters", "spike_ratio", "leak_severity",
                     "risk_level", "leak_probability")
             .orderBy(F.desc("spike_ratio"), "household_id", "timestamp").limit(n))


def _hash_key(*cols: Column) -> Column:
    return F.md5(F.concat_ws("|", *cols))


def sample_rows(r: DataFrame, n: int = 3000, seed: int = 42) -> DataFrame:
    """exactly min(n, rows) rows, repeatable: the n smallest row hashes."""
    k = _hash_key(F.col("household_id"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(str(seed)))
    return r.withColumn("_k", k).orderBy("_k").limit(n).drop("_k")


def sample_households(r: DataFrame, n: int = 200, seed: int = 42) -> DataFrame:
    """All rows of n households chosen by hash; Spark broadcasts the list of ids if it's small."""
    ids = (r.select("household_id").distinct()
            .withColumn("_k", F.md5(F.concat(F.col("household_id"), F.lit(f":{seed}"))))
            .orderBy("_k").limit(n).select("household_id"))
    return r.join(ids, "household_id", "left_semi")


# --- explorer and summaries (E30, E34, E35, F4) ------------------------------------
def insights(r: DataFrame) -> DataFrame:
    """Typed one-row insight panel."""
    numbers = ("peak_avg", "low_avg", "avg_spike")
    return shown(_insights(r), *numbers)


def _insights(r: DataFrame) -> DataFrame:
    """Two levels, no join: one aggregate per hour (at most 24 + 1 rows), then one
    global aggregate that picks the peak/low hour and totals the counters.
    """
    sp, rl = F.col("spike_ratio"), F.col("risk_level")
    h = r.groupBy("hour").agg(
        F.count(F.lit(1)).alias("n"), F.sum("water_usage_liters").alias("su"),
        F.count("water_usage_liters").alias("cu"),
        F.count(F.when(sp > 2, 1)).alias("c2"), F.count(F.when(sp > 3, 1)).alias("c3"),
        F.sum(sp).alias("ss"), F.count(sp).alias("cs"),
        F.sum("leak_flag_detected").alias("lf"), F.count("leak_flag_detected").alias("cf"),
        F.count(F.when(rl == "Critical", 1)).alias("ccrit"), F.count(F.when(rl == "High Risk", 1)).alias("chigh"))
    a = F.when(F.col("hour").isNotNull(), F.col("su") / F.col("cu"))
    h = h.withColumn("a", a)
    n = F.sum("n")
    return h.agg(
        F.max_by("hour", F.when(F.col("a").isNotNull(), F.struct(F.col("a"), -F.col("hour")))).alias("peak_hour"),
        F.max("a").alias("peak_avg"),
        F.min_by("hour", F.when(F.col("a").isNotNull(), F.struct(F.col("a"), F.col("hour")))).alias("low_hour"),
        F.min("a").alias("low_avg"),
        safe_pct(F.sum("c2"), n).alias("pct_gt2"), safe_pct(F.sum("c3"), n).alias("pct_gt3"),
        (F.sum("ss") / F.sum("cs")).alias("avg_spike"),
        safe_pct(F.sum("lf"), F.sum("cf")).alias("leak_rate_pct"),
        safe_pct(F.sum("ccrit"), n).alias("pct_critical"), safe_pct(F.sum("chigh"), n).alias("pct_high_risk"),
    ).withColumn("pct_normal", F.lit(100.0) - F.col("pct_gt2"))


#: Kind and text of the insight lines; the slots take numbers that are text already.
INSIGHT_LINES = [
    ("info", "Demand peaks at %02d:00 with %s L on average and is lowest at %02d:00."),
    ("warning", "%s%% of readings spike above twice their baseline, %s%% above three times."),
    ("info", "The mean spike ratio is %s; meters above 2 are worth a look."),
    ("danger", "%s%% of all readings are flagged as leaks."),
    ("warning", "%s%% of readings are in the Critical tier and %s%% in High Risk."),
    ("success", "%s%% of readings stay within twice their baseline."),
]


def insights_text(r: DataFrame) -> DataFrame:
    """E30 rendered as (line, kind, text)."""
    i = _insights(r)
    args = [
        [F.col("peak_hour"), _fixed("peak_avg", 1), F.col("low_hour")],
        [_fixed("pct_gt2", 1), _fixed("pct_gt3", 1)],
        [_fixed("avg_spike", 3)],
        [_fixed("leak_rate_pct", 1)],
        [_fixed("pct_critical", 1), _fixed("pct_high_risk", 1)],
        [_fixed("pct_normal", 1)],
    ]
    lines = F.array(*[F.struct(F.lit(kind).alias("kind"), F.format_string(tpl, *a).alias("text"))
                      for (kind, tpl), a in zip(INSIGHT_LINES, args)])
    return i.select(F.posexplode(lines).alias("line", "s")).select("line", "s.kind", "s.text")


def monthly(r: DataFrame) -> DataFrame:
    """Per month mean usage, leak sum, mean spike."""
    x = r.where(F.col("timestamp").isNotNull()).groupBy(F.date_trunc("month", "timestamp").cast("date").alias("_m"))
    return x.agg(
        r6(F.avg("water_usage_liters")).alias("avg_usage"),
        F.sum("leak_flag_detected").cast("long").alias("leak_events"),
        r6(F.avg("spike_ratio")).alias("avg_spike")).select(
        F.date_format("_m", "yyyy-MM").alias("month"), "avg_usage", "leak_events", "avg_spike")


NUMERIC_TYPES = ("int", "bigint", "double", "float", "smallint", "tinyint")


def describe_numeric(r: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Count, mean, std, min, quartiles, max per numeric column; one row per column.

    The columns are stacked long, each under its name: moments are one aggregate,
    quartiles the narrowing in ``operators.quantiles``, both by column. Built
    lazily; never ``DataFrame.summary`` (string-typed, approximate).
    """
    from hydrolens.operators.quantiles import quantile_columns
    types = dict(r.dtypes)
    cols = [c for c in (cols or r.columns) if types.get(c) in NUMERIC_TYPES]
    names = ["p25", "p50", "p75"]
    # columns are numbered while they are counted: a number is a narrower key than a name
    long = r.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v"))
                                        for i, c in enumerate(cols)])).alias("s")).select("s.*")
    if approx:
        q = long.groupBy("c").agg(F.percentile_approx("v", [0.25, 0.5, 0.75], 10000).alias("_q")).select(
            F.col("c").alias("_c"), *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    else:
        q = quantile_columns(long, "v", [0.25, 0.5, 0.75], names, ["c"], few_groups=True).withColumnRenamed("c", "_c")
    # one aggregate without a key: it has its row for a table without rows too
    moments = r.agg(F.array(*[F.struct(
        F.lit(i).alias("c"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max")) for i, v in enumerate(F.col(c).cast("double") for c in cols)]).alias("m"))
    rows = moments.select(F.explode("m").alias("m")).select("m.*")
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("c") + 1)
    return rows.join(q, F.col("c") == F.col("_c"), "left").select(
        name.alias("column"), "count", r6("mean").alias("mean"), r6("std").alias("std"), "min",
        *[r6(n).alias(n) for n in names], "max")


def explore(r: DataFrame, cols: Sequence[str], sort_col: str, ascending: bool = False) -> DataFrame:
    """chosen columns sorted by one of them; NULLs last either way (pandas)."""
    x = project(r, cols)
    o = F.col(sort_col).asc_nulls_last() if ascending else F.col(sort_col).desc_nulls_last()
    return x.orderBy(o)
