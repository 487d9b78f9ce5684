"""Sinks (A5, A6): distributed writes, no driver collect."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from hydrolens.functions.columns import month_of


#: Bytes of a Parquet row group, the least that a lookup can skip.
ROW_GROUP = 16 << 20


def write_readings(r: DataFrame, path: str, partition_by_month: bool = True) -> None:
    """Snappy Parquet in a folder for each month, so that time filters prune folders.

    Rows are rebalanced by month: Spark splits a month into files of the advisory
    partition size and joins small ones, so the number of files follows the data
    (about one a month and advisory size), not months times tasks. A local sort
    keeps each file household-clustered, in row groups of 16 MB, so that a lookup of
    one household skips most of them by their bounds (and, where ids are not held in a
    dictionary, by a Bloom filter).
    """
    options = {"compression": "snappy", "parquet.block.size": ROW_GROUP, "parquet.bloom.filter.enabled#household_id": "true"}
    if partition_by_month:
        w = r.withColumn("month", month_of("timestamp")).hint("rebalance", "month").sortWithinPartitions(
            "month", "household_id", "timestamp")
        writer = w.write.mode("overwrite").options(**options).partitionBy("month")
    else:
        w = r.sortWithinPartitions("household_id", "timestamp")
        writer = w.write.mode("overwrite").options(**options)
    writer.parquet(path)


def export_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Header CSV, one part file per partition (never funnelled through one task)."""
    out = df.select(*columns) if columns else df
    (out.write.mode("overwrite").option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path))
