"""Independent DuckDB SQL for each registered query (correctness oracle).

Written against the raw views (events, lineitem) with DuckDB's own window
frames; shares no code with the Spark plans. Everything is computed on plain
doubles; only the columns of a finished result are rounded, to 6 decimals.
"""
from __future__ import annotations

_RAW = {
    "events": """
  SELECT 'HH' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS household_id,
         date_trunc('hour', ts) AS timestamp,
         SUM(CAST(value AS DECIMAL(24,6))) AS usage
  FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL
  GROUP BY 1, 2""",
    "lineitem": """
  SELECT 'HH' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS household_id,
         date_trunc('hour', CAST(l_shipdate AS TIMESTAMP)) AS timestamp,
         SUM(CAST(l_quantity AS DECIMAL(24,6))) AS usage
  FROM lineitem WHERE l_shipdate IS NOT NULL AND l_suppkey IS NOT NULL AND l_quantity IS NOT NULL
  GROUP BY 1, 2""",
}


def readings_cte(source: str = "events") -> str:
    return f"""WITH raw AS ({_RAW[source]}
), roll AS (
  SELECT household_id, timestamp, CAST(usage AS DOUBLE) AS water_usage_liters,
         CAST(SUM(usage) OVER w AS DOUBLE) / COUNT(*) OVER w AS avg7
  FROM raw
  WINDOW w AS (PARTITION BY household_id ORDER BY timestamp
               RANGE BETWEEN INTERVAL 167 HOURS PRECEDING AND CURRENT ROW)
), spk AS (
  SELECT *, CASE WHEN avg7 = 0 THEN CAST(0 AS DOUBLE) ELSE water_usage_liters / avg7 END AS spike_ratio FROM roll
), prob AS (
  SELECT household_id, timestamp, CAST(hour(timestamp) AS INTEGER) AS hour, water_usage_liters, spike_ratio,
         CAST(0.6 AS DOUBLE) * least(greatest((spike_ratio - 1) / 2, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))
         + CAST(0.25 AS DOUBLE) * (CAST(SUM(CASE WHEN spike_ratio > 1 THEN 1 ELSE 0 END) OVER w AS DOUBLE) / COUNT(*) OVER w)
         + CASE WHEN hour(timestamp) <= 5 AND spike_ratio > 1 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
           AS leak_probability
  FROM spk
  WINDOW w AS (PARTITION BY household_id ORDER BY timestamp
               RANGE BETWEEN INTERVAL 23 HOURS PRECEDING AND CURRENT ROW)
), readings AS (
  SELECT household_id, timestamp, hour, water_usage_liters, spike_ratio, leak_probability,
         CASE WHEN leak_probability > 0.8 THEN 1 ELSE 0 END AS leak_flag_detected,
         CASE WHEN leak_probability < 0.2 THEN 'Normal' WHEN leak_probability < 0.4 THEN 'Low Risk'
              WHEN leak_probability < 0.7 THEN 'Moderate Risk' WHEN leak_probability <= 0.9 THEN 'High Risk'
              ELSE 'Critical Leak' END AS leak_severity,
         CASE WHEN leak_probability < 0.4 THEN 'Low Risk' WHEN leak_probability < 0.7 THEN 'Moderate Risk'
              WHEN leak_probability <= 0.9 THEN 'High Risk' ELSE 'Critical' END AS risk_level
  FROM prob
)
"""


def on(source: str, body: str) -> str:
    return readings_cte(source) + body


AVG_USAGE = "AVG(water_usage_liters)"
READING_COLS = ("household_id, timestamp, hour, water_usage_liters, spike_ratio, leak_probability, "
                "leak_flag_detected, leak_severity, risk_level")
FILTER_WHERE = ("risk_level IN ('Moderate Risk', 'High Risk', 'Critical') AND leak_severity IS NOT NULL "
                "AND hour BETWEEN 6 AND 22 AND spike_ratio >= 1.2")


def fixed(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f', {expr})"


def shown(table: str, columns: str, rest: str = "") -> str:
    """The rows of a table with some columns rounded, and nothing done to them afterwards."""
    made = ", ".join(f"round({c}, 6) AS {c}" for c in columns.split())
    return f" SELECT * REPLACE ({made}) FROM {table}{rest}"


MEANS = ("avg_usage std_usage avg_spike_ratio std_spike_ratio avg_leak_prob night_avg_usage day_avg_usage night_day_ratio "
         "usage_range cv_usage")


SEV_RANK = ("CASE leak_severity WHEN 'Normal' THEN 0 WHEN 'Low Risk' THEN 1 WHEN 'Moderate Risk' THEN 2 "
            "WHEN 'High Risk' THEN 3 WHEN 'Critical Leak' THEN 4 END")
RISK_RANK = ("CASE risk_level WHEN 'Low Risk' THEN 0 WHEN 'Moderate Risk' THEN 1 WHEN 'High Risk' THEN 2 "
             "WHEN 'Critical' THEN 3 END")

SQL: dict[str, str] = {}

SQL["enrich_readings"] = on("events", f"SELECT {READING_COLS} FROM readings")
SQL["enrich_readings_lineitem"] = on("lineitem", f"SELECT {READING_COLS} FROM readings")
SQL["enrich_instalments"] = SQL["enrich_readings"]
SQL["scan_parquet"] = SQL["enrich_readings"]
SQL["scan_csv"] = SQL["enrich_readings"]
SQL["sink_parquet"] = SQL["enrich_readings"]
SQL["export_filtered_csv"] = on("events", f"SELECT {READING_COLS} FROM readings WHERE {FILTER_WHERE}")
SQL["derive_calendar"] = on("events", f"""
SELECT {READING_COLS}, CAST(timestamp AS DATE) AS date, strftime(timestamp, '%Y-%m') AS month,
       dayname(timestamp) AS day_of_week FROM readings""")
SQL["ordinal_encode"] = on("events", f"""
SELECT {READING_COLS}, {SEV_RANK} AS sev_order, {RISK_RANK} AS risk_order FROM readings""")
SQL["project_columns"] = on("events", "SELECT household_id, timestamp, spike_ratio, risk_level FROM readings")
SQL["anomaly_band"] = on("events", """
SELECT household_id, timestamp, water_usage_liters, spike_ratio, risk_level,
       CASE WHEN spike_ratio > 3 THEN 'Spike > 3' WHEN spike_ratio > 2 THEN 'Spike > 2' ELSE 'Normal' END AS anomaly
FROM readings""")
SQL["methodology_spike_band"] = on("events", f"""
SELECT {READING_COLS}, CASE WHEN spike_ratio < 1.0 THEN 'normal' WHEN spike_ratio < 1.5 THEN 'expected'
       WHEN spike_ratio <= 3.0 THEN 'moderate' WHEN spike_ratio IS NOT NULL THEN 'severe' END AS band FROM readings""")
SQL["probability_band"] = on("events", f"""
SELECT {READING_COLS}, CASE WHEN leak_probability < 0.3 THEN 'low' WHEN leak_probability < 0.7 THEN 'medium'
       WHEN leak_probability IS NOT NULL THEN 'high' END AS band FROM readings""")
SQL["dataset_info"] = on("events", """
SELECT COUNT(*) AS n_records, CAST(MIN(timestamp) AS DATE) AS min_date, CAST(MAX(timestamp) AS DATE) AS max_date
FROM readings""")
SQL["dataset_info_lineitem"] = SQL["dataset_info"].replace(readings_cte("events"), readings_cte("lineitem"))

SQL["global_filter"] = on("events", f"SELECT {READING_COLS} FROM readings WHERE {FILTER_WHERE}")
SQL["filter_options"] = on("events", """
SELECT 'risk_level' AS facet, risk_level AS value,
       CAST(COALESCE(CASE risk_level WHEN 'Low Risk' THEN 0 WHEN 'Moderate Risk' THEN 1 WHEN 'High Risk' THEN 2
                     WHEN 'Critical' THEN 3 END, 99) AS BIGINT) AS ord
FROM (SELECT DISTINCT risk_level FROM readings WHERE risk_level IS NOT NULL)
UNION ALL
SELECT 'leak_severity', leak_severity,
       CAST(COALESCE(CASE leak_severity WHEN 'Normal' THEN 0 WHEN 'Low Risk' THEN 1 WHEN 'Moderate Risk' THEN 2
                     WHEN 'High Risk' THEN 3 WHEN 'Critical Leak' THEN 4 END, 99) AS BIGINT)
FROM (SELECT DISTINCT leak_severity FROM readings WHERE leak_severity IS NOT NULL)
UNION ALL
SELECT 'household_id', household_id, CAST(NULL AS BIGINT) FROM (SELECT DISTINCT household_id FROM readings)
UNION ALL SELECT 'hour_min', CAST(MIN(hour) AS VARCHAR), CAST(0 AS BIGINT) FROM readings
UNION ALL SELECT 'hour_max', CAST(MAX(hour) AS VARCHAR), CAST(1 AS BIGINT) FROM readings
UNION ALL SELECT 'spike_max', printf('%.6f', MAX(spike_ratio)), CAST(2 AS BIGINT) FROM readings""")
SQL["household_search"] = on("events", f"""
SELECT {READING_COLS} FROM readings WHERE regexp_matches(household_id, '(?i)hh0000[1-3]')""")
SQL["leak_events"] = on("events", """
SELECT household_id, timestamp, water_usage_liters, spike_ratio, leak_severity, leak_probability, risk_level
FROM readings WHERE leak_flag_detected = 1""")
SQL["household_timeline"] = on("events", """
, pick AS (
  SELECT household_id FROM readings GROUP BY household_id
  ORDER BY CAST(SUM(leak_flag_detected) AS BIGINT) DESC, household_id LIMIT 1)
SELECT household_id, timestamp, water_usage_liters, spike_ratio, leak_flag_detected
FROM readings WHERE household_id IN (SELECT household_id FROM pick)""")

_OVERVIEW = f"""
SELECT COUNT(*) AS n_records, COUNT(DISTINCT household_id) AS n_households,
       round({AVG_USAGE}, 6) AS avg_usage,
       CAST(COALESCE(SUM(leak_flag_detected), 0) AS BIGINT) AS n_leaks,
       CASE WHEN COUNT(*) > 0 THEN CAST(100.0 AS DOUBLE) * CAST(COALESCE(SUM(leak_flag_detected), 0) AS BIGINT) / COUNT(*)
            ELSE CAST(0 AS DOUBLE) END AS leak_pct,
       COUNT(DISTINCT CASE WHEN risk_level IN ('High Risk', 'Critical') THEN household_id END) AS n_high_risk,
       COUNT(DISTINCT CASE WHEN risk_level = 'Critical' THEN household_id END) AS n_critical,
       round(AVG(spike_ratio), 6) AS avg_spike
FROM readings"""
SQL["overview_kpis"] = on("events", _OVERVIEW)
SQL["overview_kpis_filtered"] = on("events", _OVERVIEW + f" WHERE {FILTER_WHERE}")
SQL["risk_distribution"] = on("events", """
SELECT risk_level AS label, COUNT(*) AS n_records FROM readings WHERE risk_level IS NOT NULL GROUP BY 1""")
SQL["risk_distribution_ordered"] = on("events", """
SELECT risk_level AS label, COUNT(*) AS n_records, COUNT(DISTINCT household_id) AS n_households FROM readings
WHERE risk_level IN ('Low Risk', 'Moderate Risk', 'High Risk', 'Critical') GROUP BY 1""")
SQL["severity_distribution"] = on("events", """
SELECT leak_severity AS label, COUNT(*) AS n_records FROM readings
WHERE leak_severity IN ('Normal', 'Low Risk', 'Moderate Risk', 'High Risk', 'Critical Leak') GROUP BY 1""")
SQL["severity_share"] = on("events", """
SELECT label, n_records, CAST(100.0 AS DOUBLE) * n_records / SUM(n_records) OVER () AS pct FROM (
  SELECT leak_severity AS label, COUNT(*) AS n_records FROM readings
  WHERE leak_severity IN ('Normal', 'Low Risk', 'Moderate Risk', 'High Risk', 'Critical Leak') GROUP BY 1)""")
SQL["risk_share"] = on("events", """
SELECT label, n_records, CAST(100.0 AS DOUBLE) * n_records / SUM(n_records) OVER () AS pct FROM (
  SELECT risk_level AS label, COUNT(*) AS n_records FROM readings
  WHERE risk_level IN ('Low Risk', 'Moderate Risk', 'High Risk', 'Critical') GROUP BY 1)""")
SQL["spike_histogram"] = on("events", """
, bins(bucket, ord, lo, hi) AS (VALUES ('<1', 0, 0, 1), ('1–2', 1, 1, 2), ('2–3', 2, 2, 3), ('3–4', 3, 3, 4), ('>4', 4, 4, 99))
SELECT b.bucket, b.ord, COUNT(r.spike_ratio) AS n_records
FROM bins b LEFT JOIN readings r ON r.spike_ratio > b.lo AND r.spike_ratio <= b.hi
GROUP BY b.bucket, b.ord""")
SQL["daily_leaks"] = on("events", """
SELECT CAST(timestamp AS DATE) AS date, COUNT(*) AS n FROM readings WHERE leak_flag_detected = 1 GROUP BY 1""")
SQL["daily_spikes_2"] = on("events", """
SELECT CAST(timestamp AS DATE) AS date, COUNT(*) AS n FROM readings WHERE spike_ratio > 2 GROUP BY 1""")
SQL["daily_spikes_3"] = on("events", """
SELECT CAST(timestamp AS DATE) AS date, COUNT(*) AS n FROM readings WHERE spike_ratio > 3 GROUP BY 1""")
_SEV_MONTH = """
SELECT strftime(timestamp, '%Y-%m') AS month, leak_severity, COUNT(*) AS n FROM readings
WHERE leak_severity <> 'Normal' GROUP BY 1, 2"""
SQL["severity_by_month"] = on("events", _SEV_MONTH)
SQL["severity_by_month_lineitem"] = on("lineitem", _SEV_MONTH)
SQL["usage_by_severity"] = on("events", f"""
SELECT leak_severity, round({AVG_USAGE}, 6) AS avg_usage FROM readings
WHERE leak_severity IN ('Normal', 'Low Risk', 'Moderate Risk', 'High Risk', 'Critical Leak') GROUP BY 1""")
_TOP_HIGH = f"""
, top AS (
  SELECT household_id, arg_min(risk_level, timestamp) AS risk_level,
         AVG(leak_probability) AS avg_leak_prob, AVG(spike_ratio) AS avg_spike,
         CAST(SUM(leak_flag_detected) AS BIGINT) AS leak_events, {AVG_USAGE} AS avg_usage
  FROM readings WHERE risk_level IN ('High Risk', 'Critical') GROUP BY household_id
  ORDER BY avg_leak_prob DESC, household_id LIMIT 20)"""
SQL["top_high_risk"] = on("events", _TOP_HIGH + shown("top", "avg_leak_prob avg_spike avg_usage"))
SQL["top_high_risk_display"] = on("events", _TOP_HIGH + f"""
SELECT household_id AS "Household", risk_level AS "Risk", {fixed('avg_leak_prob', 4)} AS "Leak Probability",
       {fixed('avg_spike', 2)} AS "Avg Spike Ratio", leak_events AS "Leak Events",
       {fixed('avg_usage', 1)} || ' L' AS "Avg Usage" FROM top""")


def _summary(where: str) -> str:
    return f"""
, f AS (SELECT * FROM readings {where}),
sev AS (
  SELECT household_id, leak_severity,
         ROW_NUMBER() OVER (PARTITION BY household_id ORDER BY COUNT(*) DESC, leak_severity) AS rk
  FROM f WHERE leak_severity IS NOT NULL GROUP BY household_id, leak_severity)
SELECT g.household_id, g.risk_level, s.leak_severity, g.avg_leak_prob, g.avg_spike, g.leak_events
FROM (SELECT household_id, arg_min(risk_level, timestamp) AS risk_level,
             AVG(leak_probability) AS avg_leak_prob, AVG(spike_ratio) AS avg_spike,
             CAST(SUM(leak_flag_detected) AS BIGINT) AS leak_events
      FROM f GROUP BY household_id) g
LEFT JOIN sev s ON s.household_id = g.household_id AND s.rk = 1
ORDER BY g.avg_leak_prob DESC, g.household_id LIMIT 100"""


SQL["household_summary"] = on("events", shown("(" + _summary("").replace(", f AS", "WITH f AS", 1) + ")", "avg_leak_prob avg_spike"))
SQL["household_summary_search"] = on("events", shown("(" + _summary(
    "WHERE regexp_matches(household_id, '(?i)hh0000[1-3]')").replace(", f AS", "WITH f AS", 1) + ")", "avg_leak_prob avg_spike"))
SQL["household_summary_display"] = on("events", "SELECT household_id, risk_level, leak_severity, "
    + f"{fixed('avg_leak_prob', 4)} AS avg_leak_prob, {fixed('avg_spike', 2)} AS avg_spike, leak_events FROM ("
    + _summary("WHERE regexp_matches(household_id, '(?i)hh0000[1-3]')").replace(", f AS", "WITH f AS", 1) + ")")
SQL["hourly_profile"] = on("events", f"SELECT hour, round({AVG_USAGE}, 6) AS avg_usage FROM readings WHERE hour IS NOT NULL GROUP BY hour")
SQL["peak_hours"] = on("events", f"""
, h AS (SELECT hour, {AVG_USAGE} AS a FROM readings WHERE hour IS NOT NULL GROUP BY hour)
SELECT (SELECT hour FROM h ORDER BY a DESC, hour LIMIT 1) AS peak_hour, (SELECT round(MAX(a), 6) FROM h) AS peak_avg,
       (SELECT hour FROM h ORDER BY a ASC, hour LIMIT 1) AS low_hour, (SELECT round(MIN(a), 6) FROM h) AS low_avg""")
SQL["usage_histogram"] = on("events", """
, s AS (SELECT MIN(water_usage_liters) AS mn, MAX(water_usage_liters) AS mx, COUNT(*) AS n
        FROM readings WHERE water_usage_liters IS NOT NULL),
p AS (SELECT mn, (mx - mn) / 60 AS w, n FROM s),
b AS (SELECT CAST(CASE WHEN p.w = 0 THEN 0 ELSE least(floor((r.water_usage_liters - p.mn) / p.w), 59) END AS BIGINT) AS bin
      FROM readings r, p WHERE r.water_usage_liters IS NOT NULL),
c AS (SELECT bin, COUNT(*) AS n FROM b GROUP BY bin)
SELECT g.range AS bin, round(p.mn + g.range * p.w, 6) AS lo, round(p.mn + (g.range + 1) * p.w, 6) AS hi,
       COALESCE(c.n, 0) AS n
FROM range(60) g CROSS JOIN p LEFT JOIN c ON c.bin = g.range WHERE p.n > 0""")
SQL["weekday_profile"] = on("events", f"SELECT dayname(timestamp) AS day_of_week, round({AVG_USAGE}, 6) AS avg_usage FROM readings WHERE timestamp IS NOT NULL GROUP BY 1")
SQL["usage_box_by_risk"] = on("events", """
, x AS (SELECT risk_level, water_usage_liters AS u FROM readings
        WHERE risk_level IN ('Low Risk', 'Moderate Risk', 'High Risk', 'Critical') AND water_usage_liters IS NOT NULL),
q AS (SELECT risk_level, quantile_cont(u, 0.25) AS q1, quantile_cont(u, 0.5) AS median,
             quantile_cont(u, 0.75) AS q3 FROM x GROUP BY risk_level),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.risk_level, round(f.q1, 6) AS q1, round(f.median, 6) AS median, round(f.q3, 6) AS q3,
       MIN(CASE WHEN x.u >= f.lo AND x.u <= f.hi THEN x.u END) AS whisker_lo,
       MAX(CASE WHEN x.u >= f.lo AND x.u <= f.hi THEN x.u END) AS whisker_hi,
       COUNT(CASE WHEN NOT (x.u >= f.lo AND x.u <= f.hi) THEN 1 END) AS n_outliers
FROM x JOIN f USING (risk_level) GROUP BY f.risk_level, f.q1, f.median, f.q3""")
SQL["usage_heatmap_long"] = on("events", f"""
SELECT dayname(timestamp) AS day_of_week, hour, round({AVG_USAGE}, 6) AS avg_usage FROM readings
WHERE timestamp IS NOT NULL AND hour IS NOT NULL GROUP BY 1, 2""")
SQL["usage_heatmap"] = on("events", "SELECT dayname(timestamp) AS day_of_week, " + ", ".join(
    f"round(AVG(CASE WHEN hour = {h} THEN water_usage_liters END), 6) AS h{h:02d}" for h in range(24))
    + " FROM readings WHERE timestamp IS NOT NULL AND hour IS NOT NULL GROUP BY 1")
SQL["anomaly_counts"] = on("events", """
SELECT COUNT(CASE WHEN spike_ratio > 2 THEN 1 END) AS n_gt2,
       CASE WHEN COUNT(*) > 0 THEN CAST(100.0 AS DOUBLE) * COUNT(CASE WHEN spike_ratio > 2 THEN 1 END) / COUNT(*) ELSE 0 END AS pct_gt2,
       COUNT(CASE WHEN spike_ratio > 3 THEN 1 END) AS n_gt3,
       CASE WHEN COUNT(*) > 0 THEN CAST(100.0 AS DOUBLE) * COUNT(CASE WHEN spike_ratio > 3 THEN 1 END) / COUNT(*) ELSE 0 END AS pct_gt3
FROM readings""")
SQL["worst_spike"] = on("events", """
SELECT household_id, timestamp, spike_ratio FROM readings WHERE spike_ratio IS NOT NULL
ORDER BY spike_ratio DESC, timestamp, household_id LIMIT 1""")
SQL["household_kpi"] = on("events", f"""
, g AS (SELECT household_id, arg_max_null(risk_level, timestamp) AS risk_level,
               AVG(leak_probability) AS avg_leak_prob, CAST(SUM(leak_flag_detected) AS BIGINT) AS leak_events,
               {AVG_USAGE} AS avg_usage, MAX(spike_ratio) AS max_spike
        FROM readings GROUP BY household_id)
SELECT * REPLACE (round(avg_leak_prob, 6) AS avg_leak_prob, round(avg_usage, 6) AS avg_usage),
       COALESCE(CASE risk_level WHEN 'Low Risk' THEN 'success' WHEN 'Moderate Risk' THEN '' WHEN 'High Risk' THEN 'warning'
                   WHEN 'Critical' THEN 'danger' END, '') AS risk_status,
       CASE WHEN avg_leak_prob > 0.1 THEN 'danger' ELSE '' END AS prob_status,
       CASE WHEN leak_events > 0 THEN 'danger' ELSE 'success' END AS leak_status,
       CASE WHEN max_spike > 3 THEN 'danger' WHEN max_spike > 2 THEN 'warning' ELSE '' END AS spike_status
FROM g""")
SQL["household_severity"] = on("events", """
SELECT household_id, leak_severity, COUNT(*) AS n,
       CAST(100.0 AS DOUBLE) * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY household_id) AS pct
FROM readings WHERE leak_severity IS NOT NULL GROUP BY 1, 2""")
_INSIGHTS = f"""
, h AS (SELECT hour, {AVG_USAGE} AS a FROM readings WHERE hour IS NOT NULL GROUP BY hour),
t AS (SELECT COUNT(*) AS n, COUNT(CASE WHEN spike_ratio > 2 THEN 1 END) AS c2,
             COUNT(CASE WHEN spike_ratio > 3 THEN 1 END) AS c3, AVG(spike_ratio) AS avg_spike,
             SUM(leak_flag_detected) AS lf, COUNT(leak_flag_detected) AS cf,
             COUNT(CASE WHEN risk_level = 'Critical' THEN 1 END) AS ccrit,
             COUNT(CASE WHEN risk_level = 'High Risk' THEN 1 END) AS chigh FROM readings),
i AS (
SELECT (SELECT hour FROM h ORDER BY a DESC, hour LIMIT 1) AS peak_hour, (SELECT MAX(a) FROM h) AS peak_avg,
       (SELECT hour FROM h ORDER BY a ASC, hour LIMIT 1) AS low_hour, (SELECT MIN(a) FROM h) AS low_avg,
       CASE WHEN n > 0 THEN CAST(100.0 AS DOUBLE) * c2 / n ELSE 0 END AS pct_gt2,
       CASE WHEN n > 0 THEN CAST(100.0 AS DOUBLE) * c3 / n ELSE 0 END AS pct_gt3,
       avg_spike,
       CASE WHEN cf > 0 THEN CAST(100.0 AS DOUBLE) * CAST(lf AS BIGINT) / cf ELSE 0 END AS leak_rate_pct,
       CASE WHEN n > 0 THEN CAST(100.0 AS DOUBLE) * ccrit / n ELSE 0 END AS pct_critical,
       CASE WHEN n > 0 THEN CAST(100.0 AS DOUBLE) * chigh / n ELSE 0 END AS pct_high_risk
FROM t)"""
SQL["smart_insights"] = on("events", _INSIGHTS + """
SELECT * REPLACE (round(peak_avg, 6) AS peak_avg, round(low_avg, 6) AS low_avg, round(avg_spike, 6) AS avg_spike),
       CAST(100.0 AS DOUBLE) - pct_gt2 AS pct_normal FROM i""")


def _said(line: int, kind: str, *parts: str) -> str:
    return f"SELECT {line} AS line, '{kind}' AS kind, concat({', '.join(parts)}) AS text FROM j"


_HOUR = "lpad(CAST({} AS VARCHAR), 2, '0')"
SQL["smart_insights_text"] = on("events", _INSIGHTS + """
, j AS (SELECT *, CAST(100.0 AS DOUBLE) - pct_gt2 AS pct_normal FROM i)
""" + "\nUNION ALL ".join([
    _said(0, "info", "'Demand peaks at '", _HOUR.format("peak_hour"), "':00 with '", fixed("peak_avg", 1),
          "' L on average and is lowest at '", _HOUR.format("low_hour"), "':00.'"),
    _said(1, "warning", fixed("pct_gt2", 1), "'% of readings spike above twice their baseline, '", fixed("pct_gt3", 1),
          "'% above three times.'"),
    _said(2, "info", "'The mean spike ratio is '", fixed("avg_spike", 3), "'; meters above 2 are worth a look.'"),
    _said(3, "danger", fixed("leak_rate_pct", 1), "'% of all readings are flagged as leaks.'"),
    _said(4, "warning", fixed("pct_critical", 1), "'% of readings are in the Critical tier and '", fixed("pct_high_risk", 1),
          "'% in High Risk.'"),
    _said(5, "success", fixed("pct_normal", 1), "'% of readings stay within twice their baseline.'"),
]))
SQL["top10_leak_events"] = on("events", """
SELECT household_id, CAST(SUM(leak_flag_detected) AS BIGINT) AS value FROM readings GROUP BY 1
ORDER BY value DESC, household_id LIMIT 10""")
SQL["top5_leak_events"] = SQL["top10_leak_events"].replace("LIMIT 10", "LIMIT 5")
SQL["top10_avg_spike"] = on("events", """
SELECT household_id, round(value, 6) AS value FROM (
  SELECT household_id, AVG(spike_ratio) AS value FROM readings GROUP BY 1 HAVING AVG(spike_ratio) IS NOT NULL
  ORDER BY value DESC, household_id LIMIT 10)""")
_MONTHLY = f"""
SELECT strftime(timestamp, '%Y-%m') AS month, round({AVG_USAGE}, 6) AS avg_usage,
       CAST(SUM(leak_flag_detected) AS BIGINT) AS leak_events, round(AVG(spike_ratio), 6) AS avg_spike
FROM readings GROUP BY 1"""
SQL["monthly_rollup"] = on("events", _MONTHLY)
SQL["monthly_rollup_lineitem"] = on("lineitem", _MONTHLY)
_DESCRIBE_COLS = ["hour", "water_usage_liters", "spike_ratio", "leak_flag_detected", "leak_probability"]
SQL["describe_numeric"] = on("events", " UNION ALL ".join(
    f"""SELECT '{c}' AS column, COUNT({c}) AS count, round(AVG(CAST({c} AS DOUBLE)), 6) AS mean,
       round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, CAST(MIN({c}) AS DOUBLE) AS min,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75, CAST(MAX({c}) AS DOUBLE) AS max FROM readings"""
    for c in _DESCRIBE_COLS))
SQL["anomaly_table"] = on("events", """
SELECT household_id, timestamp, water_usage_liters, spike_ratio, leak_severity, risk_level, leak_probability
FROM readings WHERE spike_ratio > 2 ORDER BY spike_ratio DESC, household_id, timestamp LIMIT 200""")
SQL["explore_sorted"] = SQL["global_filter"]
SQL["sample_scatter"] = on("events", f"""
SELECT {READING_COLS} FROM readings
ORDER BY md5(household_id || '|' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || '|42') LIMIT 3000""")
SQL["sample_households"] = on("lineitem", f"""
SELECT {READING_COLS} FROM readings WHERE household_id IN (
  SELECT household_id FROM (SELECT DISTINCT household_id FROM readings) ORDER BY md5(household_id || ':42') LIMIT 40)""")

_ROLL = f"""
, rs AS (
  SELECT {READING_COLS},
         AVG(water_usage_liters) OVER w AS roll_avg,
         stddev_samp(water_usage_liters) OVER w AS roll_std
  FROM readings
  WINDOW w AS (PARTITION BY household_id ORDER BY timestamp RANGE BETWEEN INTERVAL 167 HOURS PRECEDING AND CURRENT ROW))"""
SQL["rolling_stats"] = on("events", _ROLL + shown("rs", "roll_avg roll_std"))
SQL["zscore"] = on("events", _ROLL + """
SELECT * REPLACE (round(roll_avg, 6) AS roll_avg, round(roll_std, 6) AS roll_std),
       round((water_usage_liters - roll_avg) / CASE WHEN roll_std > 1e-9 * greatest(abs(roll_avg), 1) THEN roll_std END, 6) AS z
FROM rs""")
_OUTL = _ROLL + """
, o AS (SELECT *, COALESCE(CAST(water_usage_liters > roll_avg + CAST(3.0 AS DOUBLE) * roll_std AS INTEGER), 0) AS is_outlier
        FROM rs)"""
SQL["dynamic_threshold"] = on("events", _OUTL + shown("o", "roll_avg roll_std"))
SQL["rule_filter"] = on("events", _OUTL + """
, prof AS (SELECT household_id, hour,
                  AVG(water_usage_liters) AS m
           FROM readings GROUP BY 1, 2),
peaks AS (SELECT household_id, hour FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY household_id ORDER BY m DESC, hour) AS rk FROM prof) WHERE rk <= 3)
SELECT o.* REPLACE (round(o.roll_avg, 6) AS roll_avg, round(o.roll_std, 6) AS roll_std),
       CASE WHEN o.is_outlier = 1 AND NOT (p.household_id IS NOT NULL AND o.hour > 5) THEN 1 ELSE 0 END AS is_outlier_kept
FROM o LEFT JOIN peaks p ON p.household_id = o.household_id AND p.hour = o.hour""")
SQL["household_tier"] = on("events", """
SELECT household_id, CASE MAX(CASE risk_level WHEN 'Low Risk' THEN 0 WHEN 'Moderate Risk' THEN 1 WHEN 'High Risk' THEN 2
                               WHEN 'Critical' THEN 3 END)
       WHEN 0 THEN 'Low Risk' WHEN 1 THEN 'Moderate Risk' WHEN 2 THEN 'High Risk' WHEN 3 THEN 'Critical' END AS tier
FROM readings GROUP BY household_id""")


# --- household features, labels, split, evaluation -----------------------------------
def _hf(day_pred: str = "hour BETWEEN 6 AND 23", live: bool = False, where: str = "") -> str:
    night = "hour BETWEEN 0 AND 5"
    g = f"""
, g AS (
  SELECT household_id, {AVG_USAGE} AS avg_usage, MAX(water_usage_liters) AS max_usage,
         stddev_samp(water_usage_liters) AS std_usage, AVG(spike_ratio) AS avg_spike_ratio,
         MAX(spike_ratio) AS max_spike_ratio, stddev_samp(spike_ratio) AS std_spike_ratio,
         CAST(SUM(leak_flag_detected) AS BIGINT) AS total_leak_events, AVG(leak_probability) AS avg_leak_prob,
         COUNT(CASE WHEN risk_level = 'Critical' THEN 1 END) AS critical_events,
         COUNT(CASE WHEN risk_level = 'High Risk' THEN 1 END) AS high_risk_events,
         COUNT(CASE WHEN spike_ratio > 2 THEN 1 END) AS spike_above_2, COUNT(*) AS total_readings,
         AVG(CASE WHEN {night} THEN water_usage_liters END) AS night,
         AVG(CASE WHEN {day_pred} THEN water_usage_liters END) AS day
  FROM readings {where} GROUP BY household_id)"""
    if not live:
        return g + """
, g2 AS (SELECT * EXCLUDE (std_usage, std_spike_ratio, night, day), COALESCE(std_usage, 0) AS std_usage,
                COALESCE(std_spike_ratio, 0) AS std_spike_ratio, COALESCE(night, 0) AS night_avg_usage,
                COALESCE(day, avg_usage) AS day_avg_usage FROM g)
, hf AS (SELECT *, night_avg_usage / greatest(day_avg_usage, 0.01) AS night_day_ratio,
                max_usage - avg_usage AS usage_range, std_usage / greatest(avg_usage, 0.01) AS cv_usage FROM g2)"""
    return g + """
, g2 AS (SELECT * EXCLUDE (std_usage, std_spike_ratio),
                CASE WHEN total_readings <= 1 THEN 0 ELSE COALESCE(std_usage, 0) END AS std_usage,
                CASE WHEN total_readings <= 1 THEN 0 ELSE COALESCE(std_spike_ratio, 0) END AS std_spike_ratio,
                COALESCE(night, 0) AS night_avg_usage, COALESCE(day, avg_usage) AS day_avg_usage FROM g)
, hf AS (SELECT * EXCLUDE (night, day),
                CASE WHEN night IS NOT NULL AND day IS NOT NULL THEN night / greatest(day, 0.01) ELSE 0 END AS night_day_ratio,
                max_usage - avg_usage AS usage_range,
                CASE WHEN total_readings <= 1 THEN 0 ELSE std_usage / greatest(avg_usage, 0.01) END AS cv_usage FROM g2)"""


HF_COLS = ("household_id, avg_usage, max_usage, std_usage, avg_spike_ratio, max_spike_ratio, std_spike_ratio, "
           "total_leak_events, avg_leak_prob, critical_events, high_risk_events, spike_above_2, total_readings, "
           "night_avg_usage, day_avg_usage, night_day_ratio, usage_range, cv_usage")
_LABEL = """
, t AS (SELECT quantile_cont(avg_leak_prob, 0.75) AS tq, quantile_cont(avg_leak_prob, 0.5) AS tm FROM hf),
c AS (SELECT COUNT(DISTINCT COALESCE(CAST(hf.avg_leak_prob >= t.tq AS INTEGER), 0)) AS n1,
             COUNT(DISTINCT COALESCE(CAST(hf.avg_leak_prob > t.tm AS INTEGER), 0)) AS n2 FROM hf, t),
lab AS (SELECT hf.*, CAST(CASE WHEN c.n1 >= 2 THEN COALESCE(CAST(hf.avg_leak_prob >= t.tq AS INTEGER), 0)
                               WHEN c.n2 >= 2 THEN COALESCE(CAST(hf.avg_leak_prob > t.tm AS INTEGER), 0)
                               ELSE error('single class') END AS INTEGER) AS is_high_risk FROM hf, t, c)"""
_SPLIT = """
, s0 AS (SELECT lab.*, ROW_NUMBER() OVER (PARTITION BY is_high_risk ORDER BY md5(household_id || ':42'), household_id) AS rn,
                COUNT(*) OVER (PARTITION BY is_high_risk) AS nl FROM lab),
split AS (SELECT * EXCLUDE (rn, nl), CAST(rn <= floor(0.2 * nl + 0.5) AS INTEGER) AS is_test FROM s0)"""
_SCORED = """
, test AS (SELECT * FROM split WHERE is_test = 1),
sc AS (SELECT household_id, is_high_risk AS label, least(max_spike_ratio / 10, 1) AS score,
              CAST(least(max_spike_ratio / 10, 1) > 0.5 AS INTEGER) AS prediction, 'spike_rule' AS model FROM test
       UNION ALL
       SELECT household_id, is_high_risk, least(night_day_ratio, 1),
              CAST(least(night_day_ratio, 1) > 0.5 AS INTEGER), 'night_rule' FROM test),
cc AS (SELECT model, COUNT(CASE WHEN label = 1 AND prediction = 1 THEN 1 END) AS tp,
              COUNT(CASE WHEN label = 0 AND prediction = 1 THEN 1 END) AS fp,
              COUNT(CASE WHEN label = 1 AND prediction = 0 THEN 1 END) AS fn,
              COUNT(CASE WHEN label = 0 AND prediction = 0 THEN 1 END) AS tn FROM sc GROUP BY model),
sg AS (SELECT model, score, COUNT(CASE WHEN label = 1 THEN 1 END) AS pos, COUNT(CASE WHEN label = 0 THEN 1 END) AS neg
       FROM sc GROUP BY model, score),
auc AS (SELECT model, CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0
                       THEN CAST(SUM(neg * (2 * before + pos)) AS DOUBLE) / (CAST(2 AS DOUBLE) * SUM(pos) * SUM(neg))
                       ELSE 0 END AS auc
        FROM (SELECT *, COALESCE(SUM(pos) OVER (PARTITION BY model ORDER BY score DESC
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sg) GROUP BY model),
m AS (SELECT model, 'accuracy' AS metric, CASE WHEN tp+fp+fn+tn > 0 THEN CAST(tp + tn AS DOUBLE) / (tp+fp+fn+tn) ELSE 0 END AS value FROM cc
      UNION ALL SELECT model, 'precision', CASE WHEN tp+fp > 0 THEN CAST(tp AS DOUBLE) / (tp+fp) ELSE 0 END FROM cc
      UNION ALL SELECT model, 'recall', CASE WHEN tp+fn > 0 THEN CAST(tp AS DOUBLE) / (tp+fn) ELSE 0 END FROM cc
      UNION ALL SELECT model, 'f1', CASE WHEN 2*tp+fp+fn > 0 THEN CAST(2*tp AS DOUBLE) / (2*tp+fp+fn) ELSE 0 END FROM cc),
mt AS (SELECT * FROM m UNION ALL SELECT model, 'auc_roc', auc FROM auc
       UNION ALL SELECT model, 'TN', CAST(tn AS DOUBLE) FROM cc UNION ALL SELECT model, 'FP', CAST(fp AS DOUBLE) FROM cc
       UNION ALL SELECT model, 'FN', CAST(fn AS DOUBLE) FROM cc UNION ALL SELECT model, 'TP', CAST(tp AS DOUBLE) FROM cc),
sbs AS (SELECT metric, MAX(CASE WHEN model = 'spike_rule' THEN value END) AS a,
               MAX(CASE WHEN model = 'night_rule' THEN value END) AS b FROM mt GROUP BY metric)"""
_FIVE = "('accuracy', 'precision', 'recall', 'f1', 'auc_roc')"

SQL["household_features"] = on("events", _hf() + shown(f"(SELECT {HF_COLS} FROM hf)", MEANS))
SQL["household_features_lineitem"] = on("lineitem", _hf() + shown(f"(SELECT {HF_COLS} FROM hf)", MEANS))
SQL["household_features_live"] = on("events", _hf(
    "NOT COALESCE(hour BETWEEN 0 AND 5, false)", live=True, where=f"WHERE {FILTER_WHERE}")
    + shown(f"(SELECT {HF_COLS} FROM hf)", MEANS))
SQL["label_by_quantile"] = on("events", _hf() + _LABEL + shown("lab", MEANS))
SQL["label_by_rule"] = on("events", _hf() + shown(
    "(SELECT *, CAST(total_leak_events > 20 OR critical_events > 0 AS INTEGER) AS is_high_risk FROM hf)", MEANS))
SQL["label_distribution"] = on("events", _hf() + _LABEL + """
SELECT is_high_risk AS label, COUNT(*) AS n, CAST(100.0 AS DOUBLE) * COUNT(*) / SUM(COUNT(*)) OVER () AS pct
FROM lab GROUP BY 1""")
SQL["stratified_split"] = on("events", _hf() + _LABEL + _SPLIT + shown("split", MEANS))
SQL["class_weights"] = on("events", _hf() + _LABEL + _SPLIT + """
SELECT n_neg, n_pos, CASE WHEN n_pos > 0 THEN CAST(n_neg AS DOUBLE) / n_pos ELSE 1.0 END AS ratio FROM (
  SELECT COUNT(CASE WHEN is_high_risk = 0 THEN 1 END) AS n_neg, COUNT(CASE WHEN is_high_risk = 1 THEN 1 END) AS n_pos
  FROM split WHERE is_test = 0)""")
_EVAL = _hf() + _LABEL + _SPLIT + _SCORED
SQL["classification_metrics"] = on("events", _EVAL + " SELECT * FROM m")
SQL["confusion_matrix"] = on("events", _EVAL + """
SELECT model, 0 AS actual, 0 AS predicted, tn AS n FROM cc UNION ALL SELECT model, 0, 1, fp FROM cc
UNION ALL SELECT model, 1, 0, fn FROM cc UNION ALL SELECT model, 1, 1, tp FROM cc""")
SQL["roc_curve"] = on("events", _EVAL + """
, cu AS (SELECT model, score, SUM(pos) OVER w AS cp, SUM(neg) OVER w AS cn,
                SUM(pos) OVER (PARTITION BY model) AS P, SUM(neg) OVER (PARTITION BY model) AS N
         FROM sg WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT model, CAST('inf' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
FROM (SELECT DISTINCT model FROM sc)
UNION ALL
SELECT model, round(score, 6), CASE WHEN N > 0 THEN CAST(cn AS DOUBLE) / N ELSE 0 END,
       CASE WHEN P > 0 THEN CAST(cp AS DOUBLE) / P ELSE 0 END FROM cu""")
SQL["auc_roc"] = on("events", _EVAL + " SELECT * FROM auc")
SQL["classification_report"] = on("events", _EVAL + """
, r AS (SELECT model, tp, fp, fn, tn, tp + fp + fn + tn AS n,
               CASE WHEN tp+fp > 0 THEN CAST(tp AS DOUBLE)/(tp+fp) ELSE 0 END AS p1,
               CASE WHEN tp+fn > 0 THEN CAST(tp AS DOUBLE)/(tp+fn) ELSE 0 END AS r1,
               CASE WHEN 2*tp+fp+fn > 0 THEN CAST(2*tp AS DOUBLE)/(2*tp+fp+fn) ELSE 0 END AS f1_1,
               CASE WHEN tn+fn > 0 THEN CAST(tn AS DOUBLE)/(tn+fn) ELSE 0 END AS p0,
               CASE WHEN tn+fp > 0 THEN CAST(tn AS DOUBLE)/(tn+fp) ELSE 0 END AS r0,
               CASE WHEN 2*tn+fn+fp > 0 THEN CAST(2*tn AS DOUBLE)/(2*tn+fn+fp) ELSE 0 END AS f1_0,
               tp + fn AS s1, tn + fp AS s0 FROM cc)
SELECT model, 'Normal' AS class, p0 AS precision, r0 AS recall, f1_0 AS f1, s0 AS support FROM r
UNION ALL SELECT model, 'High Risk', p1, r1, f1_1, s1 FROM r
UNION ALL SELECT model, 'accuracy', NULL, NULL, CASE WHEN n > 0 THEN CAST(tp + tn AS DOUBLE) / n ELSE 0 END, n FROM r
UNION ALL SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n FROM r
UNION ALL SELECT model, 'weighted avg',
   CASE WHEN n > 0 THEN (p0 * s0 + p1 * s1) / n ELSE 0 END, CASE WHEN n > 0 THEN (r0 * s0 + r1 * s1) / n ELSE 0 END,
   CASE WHEN n > 0 THEN (f1_0 * s0 + f1_1 * s1) / n ELSE 0 END, n FROM r""")
SQL["model_comparison"] = on("events", _EVAL + f"""
SELECT metric, a AS spike_rule, b AS night_rule,
       CASE WHEN a > b THEN 'spike_rule' WHEN b > a THEN 'night_rule' ELSE 'Tie' END AS winner_raw,
       CASE WHEN round(a, 4) > round(b, 4) THEN 'spike_rule' WHEN round(b, 4) > round(a, 4) THEN 'night_rule' ELSE 'Tie' END AS winner_4dp
FROM sbs WHERE metric IN {_FIVE}""")
SQL["comparison_tally"] = on("events", _EVAL + f"""
SELECT COUNT(CASE WHEN a > b THEN 1 END) AS spike_rule_wins, COUNT(CASE WHEN b > a THEN 1 END) AS night_rule_wins,
       COUNT(CASE WHEN NOT (a > b) AND NOT (b > a) THEN 1 END) AS ties FROM sbs WHERE metric IN {_FIVE}""")
SQL["metrics_summary"] = on("events", _EVAL + f"""
SELECT metric, round(a, 6) AS spike_rule, round(b, 6) AS night_rule,
       CASE WHEN metric NOT IN {_FIVE} THEN NULL WHEN round(a, 4) > round(b, 4) THEN 'spike_rule'
            WHEN round(b, 4) > round(a, 4) THEN 'night_rule' ELSE 'Tie' END AS winner FROM sbs""")
SQL["ensemble_verdict"] = on("events", _EVAL + """
SELECT a.household_id, a.prediction AS pred_a, b.prediction AS pred_b, round((a.score + b.score) / 2, 6) AS avg_prob,
       CASE WHEN a.prediction = 1 AND b.prediction = 1 THEN 'HIGH RISK' WHEN a.prediction = 0 AND b.prediction = 0 THEN 'NORMAL'
            ELSE 'MANUAL REVIEW' END AS verdict
FROM sc a JOIN sc b ON a.household_id = b.household_id AND a.model = 'spike_rule' AND b.model = 'night_rule'""")

SQL["stream_hourly_rollup"] = f"WITH raw AS ({_RAW['events']}) SELECT household_id, timestamp, CAST(usage AS DOUBLE) AS usage FROM raw"

SQL["model_card"] = on("events", _hf() + _LABEL + _SPLIT + """
, sizes AS (SELECT CAST(COUNT(CASE WHEN is_test = 0 THEN 1 END) AS VARCHAR) AS tr,
                   CAST(COUNT(CASE WHEN is_test = 1 THEN 1 END) AS VARCHAR) AS te FROM split)
SELECT * FROM (VALUES
  ('rf', 'numTrees', '100'), ('rf', 'maxDepth', '8'), ('rf', 'seed', '42'), ('rf', 'class_weight', 'balanced'),
  ('gbt', 'maxIter', '150'), ('gbt', 'maxDepth', '6'), ('gbt', 'stepSize', '0.1'), ('gbt', 'subsamplingRate', '0.8'),
  ('gbt', 'featureSubsetStrategy', '0.8'), ('gbt', 'seed', '42'), ('gbt', 'pos_weight', 'neg/pos'),
  ('rf', 'test_size', '0.2'), ('rf', 'random_state', '42'), ('gbt', 'test_size', '0.2'), ('gbt', 'random_state', '42')
) AS t(model, key, value)
UNION ALL SELECT 'rf', 'training_samples', tr FROM sizes UNION ALL SELECT 'rf', 'test_samples', te FROM sizes
UNION ALL SELECT 'gbt', 'training_samples', tr FROM sizes UNION ALL SELECT 'gbt', 'test_samples', te FROM sizes""")


# --- sources, empty selections, and what the tables determine of the models' outputs ------------
SQL["resolve_source"] = SQL["scan_parquet"]
SQL["empty_selection"] = on("events", f"""
SELECT 'example' AS selection, COUNT(*) = 0 AS is_empty FROM readings WHERE {FILTER_WHERE}
UNION ALL SELECT 'none', true""")

_INPUTS = ["avg_usage", "max_usage", "std_usage", "night_avg_usage", "avg_spike_ratio", "max_spike_ratio", "std_spike_ratio",
           "night_day_ratio", "usage_range", "cv_usage"]


def _long(table: str, columns: list[str], value: str = "{c}") -> str:
    return " UNION ALL ".join(
        f"SELECT household_id, {i} AS position, round({value.format(c=c)}, 6) AS value FROM {table}" for i, c in enumerate(columns))


SQL["feature_vector"] = on("events", _hf() + " " + _long("hf", _INPUTS))
SQL["legacy_features"] = on("events", _hf() + " " + _long("hf", _INPUTS[:7]))
_MOMENTS = ", mo AS (SELECT " + ", ".join(f"AVG({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _INPUTS) + " FROM split WHERE is_test = 0)"
SQL["scale_features"] = on("events", _hf() + _LABEL + _SPLIT + _MOMENTS + " " + _long(
    "split, mo", _INPUTS, "({c} - m_{c}) / CASE WHEN s_{c} > 1e-9 * greatest(abs(m_{c}), 1) THEN s_{c} ELSE 1 END"))

_PARTS = _hf() + _LABEL + _SPLIT
_OK = "true AS in_range, true AS agrees"


def _models(columns: str, table: str) -> str:
    return f"SELECT 'rf' AS model, {columns} FROM {table} UNION ALL SELECT 'gbt', {columns} FROM {table}"


SQL["train_rf"] = on("events", _PARTS + f" SELECT 'rf' AS model, household_id, is_high_risk AS label, true AS learned, {_OK} FROM split WHERE is_test = 1")
SQL["train_gbt"] = SQL["train_rf"].replace("'rf' AS model", "'gbt' AS model")
_RULED = _LABEL[:_LABEL.index("\n, t AS")] + """
, lab AS (SELECT *, CAST(total_leak_events > 20 OR critical_events > 0 AS INTEGER) AS is_high_risk FROM hf)"""
SQL["train_rf_notebook"] = on("events", _hf() + _RULED + _SPLIT + f"""
SELECT 'rf_notebook' AS model, household_id, is_high_risk AS label, true AS learned, {_OK} FROM split WHERE is_test = 1""")
SQL["score_households"] = on("events", _PARTS + " " + _models(f"household_id, is_high_risk AS label, true AS learned, {_OK}", "split"))
SQL["model_metrics"] = on("events", _PARTS + " " + _models("metric, true AS in_range", """
(SELECT unnest(['accuracy', 'precision', 'recall', 'f1', 'auc_roc']) AS metric)"""))
SQL["model_confusion_matrix"] = on("events", _PARTS + " " + _models("is_high_risk AS actual, n", """
(SELECT is_high_risk, COUNT(*) AS n FROM split WHERE is_test = 1 GROUP BY 1)"""))
SQL["model_roc_curve"] = on("events", _PARTS + " " + _models("""CAST(0 AS DOUBLE) AS fpr_first, CAST(0 AS DOUBLE) AS tpr_first,
 CAST(n0 > 0 AS DOUBLE) AS fpr_last, CAST(n1 > 0 AS DOUBLE) AS tpr_last, true AS turns""", """
(SELECT COUNT(CASE WHEN is_high_risk = 0 THEN 1 END) AS n0, COUNT(CASE WHEN is_high_risk = 1 THEN 1 END) AS n1
 FROM split WHERE is_test = 1)"""))
SQL["model_auc_roc"] = "SELECT unnest(['rf', 'gbt']) AS model, true AS in_range, true AS above_chance"
SQL["model_classification_report"] = on("events", _PARTS + " " + _models("class, support", """
(SELECT CASE is_high_risk WHEN 0 THEN 'Normal' ELSE 'High Risk' END AS class, COUNT(*) AS support
   FROM split WHERE is_test = 1 GROUP BY 1
 UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), COUNT(*) FROM split WHERE is_test = 1)"""))
SQL["model_comparison_ml"] = "SELECT unnest(['accuracy', 'precision', 'recall', 'f1', 'auc_roc']) AS metric, true AS agrees"
SQL["metrics_summary_ml"] = """
SELECT unnest(['accuracy', 'precision', 'recall', 'f1', 'auc_roc', 'TN', 'FP', 'FN', 'TP']) AS metric, true AS rf_known, true AS gbt_known"""
SQL["feature_importance"] = f"SELECT unnest({_INPUTS}) AS feature, true AS rf_in_range, true AS gbt_in_range, true AS rf_whole, true AS gbt_whole"
SQL["ensemble_verdict_ml"] = on("events", "SELECT DISTINCT household_id, true AS agrees, true AS in_range, true AS varied FROM readings")
SQL["probability_band_model"] = on("events", "SELECT DISTINCT household_id, true AS agrees, true AS varied FROM readings")
SQL["whatif_score"] = on("events", f"""
SELECT scenario, household_id, model, true AS lowers, {_OK}
FROM (SELECT DISTINCT household_id FROM readings WHERE {FILTER_WHERE}),
     (SELECT unnest(['night_usage_x2', 'spikes_calm', 'volatile']) AS scenario), (SELECT unnest(['rf', 'gbt']) AS model)""")
SQL["model_roundtrip"] = on("events", "SELECT COUNT(DISTINCT household_id) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM readings")
SQL["metrics_roundtrip"] = "SELECT CAST(0 AS BIGINT) AS n_different"
SQL["cross_validate"] = on("events", """
SELECT CAST(CAST('0x' || substr(md5(household_id || ':42'), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold, 'rf' AS model,
       COUNT(DISTINCT household_id) AS n, true AS in_range, true AS learned FROM readings GROUP BY 1""")
