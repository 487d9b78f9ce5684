"""Reusable Column expressions. All JVM-side built-ins: no Python UDF anywhere."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens.schema import RISK_LABELS, SEVERITY_LABELS

DIGITS = 6  # output rounding of non-exact doubles (means of ratios, std, quantiles)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: str | Column) -> Column:
    """Round a floating result so that summation order cannot change the answer."""
    return F.round(col(c), DIGITS)


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Round the named columns of a finished result; nothing is ranked, compared or fitted after this."""
    return df.withColumns({c: r6(c) for c in columns})


def nan_to_null(c: str | Column) -> Column:
    """pandas NaN is 'missing'; Spark NaN compares greater than any number."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def safe_pct(num: Column, den: Column) -> Column:
    """100*num/den, 0 for an empty denominator."""
    return F.when(den > 0, F.lit(100.0) * num / den).otherwise(F.lit(0.0))


def label_rank(c: str | Column, labels: Sequence[str]) -> Column:
    """Label -> position in ``labels``; NULL for labels outside the vocabulary."""
    pairs = []
    for i, lab in enumerate(labels):
        pairs += [F.lit(lab), F.lit(i)]
    return F.create_map(*pairs)[col(c)]


def severity_rank(c: str | Column = "leak_severity") -> Column:
    return label_rank(c, SEVERITY_LABELS)


def risk_rank(c: str | Column = "risk_level") -> Column:
    return label_rank(c, RISK_LABELS)


def rank_to_label(c: str | Column, labels: Sequence[str]) -> Column:
    """Vocabulary rank -> label; NULL (or out-of-range) rank -> NULL."""
    rank = col(c).cast("int")
    return F.when(rank.between(0, len(labels) - 1),
                  F.element_at(F.array(*[F.lit(x) for x in labels]), rank + 1))


def first_label(c: str | Column, ts: str = "timestamp") -> Column:
    """Earliest label that isn't missing, whatever the vocabulary ("first" skips missing values)."""
    return F.min_by(col(c), F.when(col(c).isNotNull(), col(ts)))


def last_label(c: str | Column, ts: str = "timestamp") -> Column:
    """Label of the latest row, missing if that row's label is missing ("last row" semantics)."""
    return F.max_by(col(c), ts)


def hour_index(ts: str | Column) -> Column:
    """Whole hours since 1970-01-01 of a wall-clock (NTZ) timestamp; no time zone involved."""
    ts = col(ts)
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 24
            + F.hour(ts).cast("long"))


def hour_start_ntz(hidx: str | Column) -> Column:
    """Inverse of ``hour_index``: the NTZ timestamp at the start of that hour (no time zone involved)."""
    h = col(hidx)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(h / 24).cast("int"))
    return day.cast("timestamp_ntz") + F.make_dt_interval(hours=(h - F.floor(h / 24) * 24).cast("int"))


def truncate_hour_ntz(ts: str | Column) -> Column:
    ts = col(ts)
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))


# --- calendar (B1-B3) -----------------------------------------------------------
def date_of(ts: str | Column = "timestamp") -> Column:
    return F.to_date(col(ts))


def month_of(ts: str | Column = "timestamp") -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def weekday_name(ts: str | Column = "timestamp") -> Column:
    return F.date_format(col(ts), "EEEE")


def weekday_number(ts: str | Column = "timestamp") -> Column:
    """Monday=0 .. Sunday=6."""
    return F.weekday(col(ts))


def weekday_of_number(d: str | Column) -> Column:
    """English name of a weekday number; 1970-01-05 was a Monday."""
    return F.date_format(F.date_add(F.lit("1970-01-05").cast("date"), col(d).cast("int")), "EEEE")


# --- label rules from a probability (K6-K8) ---------------------------------------
def leak_flag(p: str | Column = "leak_probability") -> Column:
    p = col(p)
    return F.when(p > 0.8, 1).otherwise(0)


def severity_of(p: str | Column = "leak_probability") -> Column:
    p = col(p)
    return (F.when(p < 0.2, "Normal").when(p < 0.4, "Low Risk").when(p < 0.7, "Moderate Risk")
            .when(p <= 0.9, "High Risk").when(p.isNotNull(), "Critical Leak"))


def risk_of(p: str | Column = "leak_probability") -> Column:
    p = col(p)
    return (F.when(p < 0.4, "Low Risk").when(p < 0.7, "Moderate Risk").when(p <= 0.9, "High Risk")
            .when(p.isNotNull(), "Critical"))


# --- bands (B8, B14, B15) ---------------------------------------------------------
def anomaly_band(s: str | Column = "spike_ratio") -> Column:
    s = col(s)
    return F.when(s > 3, "Spike > 3").when(s > 2, "Spike > 2").otherwise("Normal")


def probability_band(p: str | Column) -> Column:
    p = col(p)
    return F.when(p < 0.3, "low").when(p < 0.7, "medium").when(p.isNotNull(), "high")


def methodology_spike_band(s: str | Column = "spike_ratio") -> Column:
    s = col(s)
    return (F.when(s < 1.0, "normal").when(s < 1.5, "expected").when(s <= 3.0, "moderate")
            .when(s.isNotNull(), "severe"))


def spike_bin_ord(s: str | Column = "spike_ratio") -> Column:
    """Right-closed bins (0,1],(1,2],(2,3],(3,4],(4,99] -> 0..4; outside -> NULL."""
    s = col(s)
    return (F.when((s > 0) & (s <= 1), 0).when((s > 1) & (s <= 2), 1).when((s > 2) & (s <= 3), 2)
            .when((s > 3) & (s <= 4), 3).when((s > 4) & (s <= 99), 4))
