"""Streaming hourly rollup of raw meter events (Structured Streaming).

``stream_rollup`` (the registered form) is exact whatever the lateness: each
micro-batch is reduced to hourly partial sums per meter inside
``foreachBatch`` and written to its own ``batch=<id>`` folder with overwrite, which
makes a replayed batch idempotent. ``read_rollup`` sums the partials per
(meter, hour). The result equals the batch hourly table for any arrival order.

An event that is delivered again counts once, however late: hour, id and meter of
counted events are kept beside the sums, and a batch leaves out what earlier batches
have counted. The lookup reads the hours of the batch only. A state store
inside a watermark would forget ids beyond it, or drop late events. Both tables are
runs that merge as they grow in number (``streaming.runs``).

``live_hourly`` is the watermarked windowed aggregation for a live view. Spark
guarantees that data within the delay is counted; data later than the delay
may or may not be, so it is not the durable record.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolens.functions.columns import hour_index, truncate_hour_ntz
from hydrolens.sources.fixtures import LITRES, hourly_events, meter_id
from hydrolens.streaming import runs

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


#: What a micro-batch reads at most; a larger file is a batch of its own.
BATCH_BYTES = 512 << 20
ROLLUP = "household_id string, timestamp timestamp_ntz, usage decimal(34,6)"
#: What is kept of a counted event: its hour comes first, so that files are pruned by it.
COUNTED = "hour long, event_id long, user_id long"


def event_stream(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The events under ``path``: a Parquet file, a folder of part files, or a pattern of either."""
    folder, _, name = path.rstrip("/").rpartition("/")
    if not set("*?[]{}") & set(path):  # the source takes a single file only as a pattern
        path = f"{folder}/{{{name}}}"
    return spark.readStream.schema(EVENTS_SCHEMA).option("maxBytesPerTrigger", batch_bytes).parquet(path)


def first_deliveries(events: DataFrame, counted: DataFrame | None) -> DataFrame:
    """Each event with a meter, a time and a value once, without those counted before.

    An event is told by its id, meter and hour. Of deliveries in one batch that differ
    in more than that, the smallest value counts. Events without an id cannot be told
    apart: all of them count. ``counted`` is read only for the hours of ``events``.
    """
    ev = (events.where(F.col("ts").isNotNull() & F.col("user_id").isNotNull() & F.col("value").isNotNull())
          .select("event_id", "user_id", "ts", "value", hour_index("ts").alias("hour"),
                  F.when(F.col("event_id").isNull(), F.monotonically_increasing_id()).alias("_alone")))
    once = ev.groupBy("event_id", "user_id", "hour", "_alone").agg(F.min("ts").alias("ts"), F.min("value").alias("value"))
    if counted is None:
        return once.drop("_alone")
    span = ev.agg(F.min("hour").alias("low"), F.max("hour").alias("high")).first()
    if span.low is None:
        return once.drop("_alone")
    earlier = counted.where(F.col("hour").between(span.low, span.high))
    return once.join(earlier, ["event_id", "user_id", "hour"], "left_anti").drop("_alone")


def merged_hours(rows: DataFrame) -> DataFrame:
    return rows.groupBy("household_id", "timestamp").agg(F.sum("usage").cast("decimal(34,6)").alias("usage"))


def by_hour(rows: DataFrame) -> DataFrame:
    """Counted events in files that each hold few hours."""
    return rows.repartitionByRange("hour", "event_id").sortWithinPartitions("hour", "event_id")


def stream_rollup(spark: SparkSession, path: str, out_dir: str, checkpoint: str, batch_bytes: int = BATCH_BYTES,
                  width: int = runs.WIDTH, keep_seconds: float = runs.KEEP_SECONDS) -> None:
    """Process all files available now, in micro-batches of ``batch_bytes``, then stop.

    An empty first batch gives readers a table also where there is no event. Partial
    sums and counted events are runs (``streaming.runs``): each ``width`` of a size are merged.
    """
    ids = f"{out_dir}/ids"
    spark.createDataFrame([], ROLLUP).write.mode("overwrite").parquet(runs.path_of(out_dir, -1))

    def sink(batch: DataFrame, batch_id: int) -> None:
        runs.merge(spark, out_dir, ROLLUP, batch_id, merged_hours, width, keep_seconds)
        runs.merge(spark, ids, COUNTED, batch_id, by_hour, width, keep_seconds)
        new = first_deliveries(batch, runs.read(spark, ids, COUNTED, batch_id)).persist()
        try:
            (new.where(F.col("event_id").isNotNull()).select("hour", "event_id", "user_id").sortWithinPartitions("hour", "event_id")
             .write.mode("overwrite").parquet(runs.path_of(ids, batch_id)))
            hourly_events(new).write.mode("overwrite").parquet(runs.path_of(out_dir, batch_id))
        finally:
            new.unpersist()

    q = (event_stream(spark, path, batch_bytes).writeStream.foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_rollup(spark: SparkSession, out_dir: str) -> DataFrame:
    """Hourly usage per meter: the sum of the per-batch partial sums."""
    df = runs.read(spark, out_dir, ROLLUP)
    return df.groupBy("household_id", "timestamp").agg(F.sum("usage").cast("double").alias("usage"))


def live_hourly(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Watermarked tumbling-hour sums for a live view (update or append output mode).

    Watermarks need an instant (TIMESTAMP); meters report wall-clock NTZ
    times, so the wall clock is read as UTC (no session zone or DST shift) and
    the NTZ hour is carried along as a dependent group key.
    """
    ts = F.col("ts")
    ev = events.where(ts.isNotNull() & F.col("user_id").isNotNull() & F.col("value").isNotNull())
    instant = F.make_timestamp(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts),
                               F.lit("UTC"))
    return (ev.withColumn("_t", instant).withWatermark("_t", delay)
              .groupBy(meter_id("user_id").alias("household_id"), F.window("_t", "1 hour").alias("w"),
                       truncate_hour_ntz("ts").alias("timestamp"))
              .agg(F.sum(F.col("value").cast(LITRES)).alias("usage"))
              .select("household_id", "timestamp", "usage"))
