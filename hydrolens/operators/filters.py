"""Filters and predicates (C1-C9). All compose into a single Catalyst Filter
whose simple comparisons reach the Parquet scan as pushed filters."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolens.schema import RISK_LABELS, SEVERITY_LABELS, UNKNOWN_RANK

def global_filter(r: DataFrame, risks: Sequence[str] | None = None, severities: Sequence[str] | None = None,
                  hours: tuple[int, int] = (0, 23), min_spike: float = 0.0,
                  households: Sequence[str] | DataFrame = ()) -> DataFrame:
    """Risk IN, severity IN, hour BETWEEN (inclusive), spike >= t, household IN if given.

    ``None`` for a label list means 'all observed labels' (the sidebar default),
    which keeps every row with a non-null label.
    """
    cond = F.col("hour").between(int(hours[0]), int(hours[1])) & (F.col("spike_ratio") >= float(min_spike))
    cond = cond & (F.col("risk_level").isin(list(risks)) if risks is not None else F.col("risk_level").isNotNull())
    cond = cond & (F.col("leak_severity").isin(list(severities)) if severities is not None
                   else F.col("leak_severity").isNotNull())
    out = r.where(cond)
    if isinstance(households, DataFrame):
        ids = households.select("household_id").distinct()
        return out.join(ids, "household_id", "left_semi")
    households = list(households)
    return out.where(F.col("household_id").isin(households)) if households else out


def filter_options(r: DataFrame) -> DataFrame:
    """Distinct facet values in business order (unknown labels rank 99),
    sorted household ids, hour bounds and the spike maximum; long format
    (facet, value, ord), in that order. One pass over the readings: a row for each
    household and pair of labels, with bounds, from which the facets are small
    aggregates (their exchange is shared)."""
    per = r.groupBy("household_id", "risk_level", "leak_severity").agg(
        F.min("hour").alias("lo"), F.max("hour").alias("hi"), F.max("spike_ratio").alias("top"))
    known = F.create_map(*[x for facet, labels in (("risk_level", RISK_LABELS), ("leak_severity", SEVERITY_LABELS))
                           for i, lab in enumerate(labels) for x in (F.lit(f"{facet}/{lab}"), F.lit(i))])
    facet = lambda c: F.struct(F.lit(c).alias("facet"), F.col(c).alias("value"), F.col("lo"), F.col("hi"), F.col("top"))
    values = per.select(F.explode(F.array(*[facet(c) for c in ("household_id", "risk_level", "leak_severity")])).alias("s")).select("s.*")
    found = values.groupBy("facet", "value").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("top").alias("top"))
    rank = F.when(F.col("facet") != "household_id", F.coalesce(known[F.concat_ws("/", "facet", "value")], F.lit(UNKNOWN_RANK)))
    labels = found.where(F.col("value").isNotNull()).select("facet", "value", rank.cast("long").alias("ord"))
    bounds = found.where("facet = 'risk_level'").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("top").alias("top"))
    row = lambda facet, value, i: F.struct(F.lit(facet).alias("facet"), value.alias("value"), F.lit(i).cast("long").alias("ord"))
    three = bounds.select(F.inline(F.array(
        row("hour_min", F.col("lo").cast("string"), 0), row("hour_max", F.col("hi").cast("string"), 1),
        row("spike_max", F.format_string("%.6f", F.col("top")), 2))))
    return labels.unionByName(three).orderBy("facet", "ord", "value")


def household_search(r: DataFrame, pattern: str) -> DataFrame:
    """Case-insensitive regex partial match on the id; empty pattern = all rows."""
    if not pattern:
        return r
    return r.where(F.col("household_id").rlike("(?i)" + pattern))


def leak_events(r: DataFrame, household_id: str | None = None) -> DataFrame:
    """C4: flagged rows (of one household, or all), in time order."""
    x = r.where(F.col("leak_flag_detected") == 1)
    if household_id is not None:
        x = x.where(F.col("household_id") == household_id)
    return (x.select("household_id", "timestamp", "water_usage_liters", "spike_ratio", "leak_severity",
                     "leak_probability", "risk_level")
             .orderBy("household_id", "timestamp"))


def household_timeline(r: DataFrame, household_id: str | DataFrame) -> DataFrame:
    """One household's readings in time order (usage, spike, leak marker).

    ``household_id`` may be a one-row DataFrame (chosen by another query): a scalar
    subquery, whose value reaches the scan as a filter, as that of a literal does. No
    row selects nothing.
    """
    cols = ["household_id", "timestamp", "water_usage_liters", "spike_ratio", "leak_flag_detected"]
    if isinstance(household_id, DataFrame):
        x = r.where(F.col("household_id") == household_id.select("household_id").limit(1).scalar())
    else:
        x = r.where(F.col("household_id") == household_id)
    return x.select(*cols).orderBy("timestamp")


def is_empty(r: DataFrame) -> bool:
    """The dashboard stops on an empty selection; operators here just return empty frames."""
    return r.isEmpty()


# short names used in the operator inventory
search = household_search
timeline = household_timeline
