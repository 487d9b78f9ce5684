"""Sources and sinks."""
import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from hydrolens.operators.enrich import enrich
from hydrolens.sources.fixtures import raw_from_events
from hydrolens.sources.readers import CSV_NAME, PARQUET_NAME, load_readings, read_readings, resolve_source
from hydrolens.sources.writers import export_csv, write_readings


def test_resolve_and_roundtrip(spark, tmp_path):
    r = enrich(raw_from_events(spark, SF0001))
    d = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        resolve_source(spark, d)
    export_csv(r, f"{d}/{CSV_NAME}")
    assert resolve_source(spark, d)[1] == "csv"
    back = load_readings(spark, d)
    assert back.exceptAll(r).count() == 0 and r.exceptAll(back).count() == 0
    write_readings(r, f"{d}/{PARQUET_NAME}")
    assert resolve_source(spark, d)[1] == "parquet"                  # parquet preferred
    back = load_readings(spark, d)
    assert back.exceptAll(r).count() == 0 and r.exceptAll(back).count() == 0


def test_nan_becomes_null(spark, tmp_path, h1):
    p = str(tmp_path / "nan")
    h1.withColumn("spike_ratio", F.when(F.col("household_id") == "HH000003", F.lit(float("nan")))
                  .otherwise(F.col("spike_ratio"))).write.parquet(p)
    r = read_readings(spark, p)
    assert r.where(F.col("spike_ratio").isNull()).count() == 1
    assert r.where(F.col("spike_ratio") > 2).count() == 3
