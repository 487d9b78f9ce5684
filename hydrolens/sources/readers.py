"""Readers for enriched readings (A1-A4): explicit schema, never inference."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolens.functions.columns import nan_to_null
from hydrolens.schema import READING_COLUMNS, READINGS
from hydrolens.session import path_exists

PARQUET_NAME = "leakage_readings.parquet"
CSV_NAME = "leakage_readings.csv"


def normalise(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL for the double columns (pandas semantics of 'missing')."""
    out = df
    for c in ("water_usage_liters", "spike_ratio", "leak_probability"):
        out = out.withColumn(c, nan_to_null(c))
    return out.select(*READING_COLUMNS)


def read_readings(spark: SparkSession, path: str | list[str], fmt: str = "parquet",
                  columns: list[str] | None = None, trusted: bool = False,
                  months: tuple[str, str] | None = None) -> DataFrame:
    """Read readings with the explicit schema. For CSV, ``columns`` gives the
    file's column order when it differs from the canonical one. ``trusted``
    skips the NaN->NULL rewrite for tables written by our own enrichment (which
    cannot produce NaN), so filters on the double columns reach the scan.
    ``months`` (first and last, as yyyy-MM) reads only their folders of a table
    written by month."""
    if fmt == "csv":
        fields = {f.name: f for f in READINGS.fields}
        schema = T.StructType([fields[c] for c in columns]) if columns else READINGS
        df = (spark.read.schema(schema).option("header", True)
              .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
              .option("mode", "FAILFAST").csv(path))
    elif fmt == "parquet":
        df = spark.read.parquet(*([path] if isinstance(path, str) else path))
        if months:
            df = df.where(F.date_format(F.col("month").cast("date"), "yyyy-MM").between(*months)
                          if dict(df.dtypes)["month"] == "date" else F.col("month").between(*months))
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in READINGS.fields])
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return df.select(*READING_COLUMNS) if trusted else normalise(df)


def resolve_source(spark: SparkSession, data_dir: str) -> tuple[str, str]:
    """Prefer the Parquet file, then the CSV one; else fail with a clear error (A3)."""
    base = data_dir.rstrip("/")
    pq, csv = f"{base}/{PARQUET_NAME}", f"{base}/{CSV_NAME}"
    if path_exists(spark, pq):
        return pq, "parquet"
    if path_exists(spark, csv):
        return csv, "csv"
    raise FileNotFoundError(f"no readings found: expected {PARQUET_NAME} or {CSV_NAME} in {data_dir}")


def load_readings(spark: SparkSession, data_dir: str) -> DataFrame:
    path, fmt = resolve_source(spark, data_dir)
    return read_readings(spark, path, fmt)
