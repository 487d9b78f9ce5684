"""Raw hourly readings derived from the driver's test tables.

``events`` -> one meter per user, value = litres; ``lineitem`` -> one meter per
supplier, quantity = litres, one reading per ship date (many months).
Both are pre-aggregated to (household, hour) with a partial aggregate before
the shuffle, so a hot meter with a third of all raw rows costs one partial
row per map task and hour, not one row per event.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens.functions.columns import hour_index, hour_start_ntz


#: Hourly litres are summed in whole microlitres, so that a sum does not depend on its order.
LITRES = "decimal(24,6)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def meter_id(key) -> F.Column:
    return F.concat(F.lit("HH"), F.lpad(F.col(key).cast("string"), 6, "0"))


def _hourly(df: DataFrame, key: str, ts, value: str) -> DataFrame:
    """Group on the numeric meter key and an integer hour index (cheap fixed-width
    keys); the id string and the NTZ timestamp are built once per group, after
    the partial aggregate, not once per raw row."""
    g = df.groupBy(F.col(key).alias("_k"), hour_index(ts).alias("_h")).agg(
        F.sum(F.col(value).cast(LITRES)).alias("usage"))
    return g.select(meter_id("_k").alias("household_id"), hour_start_ntz("_h").alias("timestamp"), "usage")


def hourly_events(events: DataFrame) -> DataFrame:
    """events (ts, user_id, value) -> (household_id, timestamp, usage) hourly sums."""
    ev = events.where(F.col("ts").isNotNull() & F.col("user_id").isNotNull() & F.col("value").isNotNull())
    return _hourly(ev, "user_id", F.col("ts"), "value")


def raw_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_events(table(spark, sf_dir, "events"))


def raw_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(
        F.col("l_shipdate").isNotNull() & F.col("l_suppkey").isNotNull() & F.col("l_quantity").isNotNull())
    return _hourly(li, "l_suppkey", F.col("l_shipdate").cast("timestamp_ntz"), "l_quantity")


RAW_SOURCES = {"events": raw_from_events, "lineitem": raw_from_lineitem}
