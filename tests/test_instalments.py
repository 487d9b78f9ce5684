"""Incremental enrichment: any split into instalments equals one enrichment of all; lookups of one household read little."""
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from hydrolens.operators import filters as C
from hydrolens.operators.enrich import enrich
from hydrolens.sources import instalments as I
from hydrolens.sources.fixtures import hourly_events
from hydrolens.sources.writers import write_readings

START = dt.datetime(2023, 12, 20)


def events(spark, seed, days, meters, n):
    rng = random.Random(seed)
    rows = [(START + dt.timedelta(minutes=rng.randrange(days[0] * 1440, days[1] * 1440)), rng.choice(meters), float(rng.randrange(1, 40)))
            for _ in range(n)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, user_id long, value double")


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_instalments_equal_one_enrichment(spark, tmp_path):
    source, store = f"{tmp_path}/source", f"{tmp_path}/store"
    assert I.read_store(spark, store).isEmpty()
    parts = [events(spark, 1, (0, 45), range(6), 3000), events(spark, 2, (40, 80), range(6), 2500),
             events(spark, 3, (9, 11), [2, 9], 60),  # late: late December, whose 190 hours end in January
             events(spark, 4, (80, 90), [1], 40)]
    want = [{"2023-12", "2024-01", "2024-02"}, {"2024-01", "2024-02", "2024-03"}, {"2023-12", "2024-01"}, {"2024-03"}]
    for i, part in enumerate(parts):
        part.coalesce(2).write.mode("append").parquet(source)
        assert set(I.add_files(spark, source, store, hourly_events)) <= want[i]
        assert same(I.read_store(spark, store), enrich(hourly_events(spark.read.parquet(source))))
    assert I.add_files(spark, source, store, hourly_events) == [] and I.versions(spark, store) == [1, 2, 3, 4]
    assert I.read_store(spark, store, {"2024-03"}).agg(F.min(F.month("timestamp")), F.max(F.month("timestamp"))).first() == (3, 3)
    assert I.drop_old(spark, store) > 0 and I.drop_old(spark, store) == 0
    assert same(I.read_store(spark, store), enrich(hourly_events(spark.read.parquet(source))))


def test_an_instalment_that_died_is_written_again(spark, tmp_path):
    source, store = f"{tmp_path}/source", f"{tmp_path}/store"
    events(spark, 5, (0, 20), range(3), 400).write.parquet(source)
    I.add_files(spark, source, store, hourly_events)
    events(spark, 6, (15, 30), range(3), 400).write.mode("append").parquet(source)
    before = {tuple(r) for r in I.read_store(spark, store).collect()}
    I.add_files(spark, source, store, hourly_events)
    os.remove(f"{store}/files/v=000002/_SUCCESS")
    assert {tuple(r) for r in I.read_store(spark, store).collect()} == before and I.versions(spark, store) == [1]
    I.add_files(spark, source, store, hourly_events)
    assert same(I.read_store(spark, store), enrich(hourly_events(spark.read.parquet(source))))


def test_empty_null_and_changed_files(spark, tmp_path):
    source, store = f"{tmp_path}/source", f"{tmp_path}/store"
    kind = "ts timestamp_ntz, user_id long, value double"
    spark.createDataFrame([(None, 1, 2.0), (START, None, 2.0), (START, 1, None)], kind).coalesce(1).write.parquet(source)
    assert I.add_files(spark, source, store, hourly_events) == [] and I.versions(spark, store) == [1]
    assert I.read_store(spark, store).isEmpty()
    name = next(f for f in os.listdir(source) if f.endswith(".parquet"))
    os.utime(f"{source}/{name}", (1, 1))
    with pytest.raises(ValueError, match="changed after it was read"):
        I.add_files(spark, source, store, hourly_events)


def _rows_scanned(frame):
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName().startswith("AdaptiveSparkPlan"):
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    out = []
    for i in range(leaves.size()):
        node = leaves.apply(i)
        while "QueryStage" in node.getClass().getSimpleName():
            node = node.plan().collectLeaves().apply(0)
        out.append(node.metrics().apply("numOutputRows").value())
    return max(out)


def test_a_lookup_reads_few_row_groups(spark, tmp_path, monkeypatch):
    from hydrolens.sources import writers
    monkeypatch.setattr(writers, "ROW_GROUP", 1 << 14)
    raw = spark.range(60 * 700).select(F.format_string("HH%06d", F.floor(F.col("id") / 700).cast("int")).alias("household_id"), (
        F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") % 700).cast("int"))).alias("timestamp"),
        (F.col("id") * 7919 % 1009).cast("decimal(24,6)").alias("usage"))
    write_readings(enrich(raw), f"{tmp_path}/r")
    r = spark.read.parquet(f"{tmp_path}/r")
    by_name = C.household_timeline(r, "HH000031")
    picked = C.household_timeline(r, r.groupBy("household_id").count().where("household_id = 'HH000031'").select("household_id"))
    assert by_name.count() == picked.count() == 700
    assert _rows_scanned(by_name) < 60 * 700 / 4
    assert "PushedFilters" in by_name._jdf.queryExecution().executedPlan().toString()
