"""Redelivered events count once; batch folders merge as they grow in number."""
import datetime as dt
import os
import time

from hydrolens.streaming import runs
from hydrolens.streaming.rollup import COUNTED, EVENTS_SCHEMA, ROLLUP, merged_hours, read_rollup, stream_rollup


def _write(spark, path, rows):
    spark.createDataFrame(rows, EVENTS_SCHEMA).coalesce(1).write.parquet(path)
    time.sleep(1.1)  # the file source orders files by modification time


def test_redelivered_events_count_once(spark, tmp_path):
    t, src = dt.datetime, str(tmp_path / "in")
    one = (1, t(2024, 1, 1, 10, 5), 7, "x", 1.25, None)
    _write(spark, f"{src}/a", [one, one, (2, t(2024, 1, 1, 12, 30), 7, "x", 2.0, None),
                               (None, t(2024, 1, 1, 12, 31), 7, "x", 4.0, None), (None, t(2024, 1, 1, 12, 31), 7, "x", 4.0, None),
                               (9, None, 7, "x", 50.0, None)])
    _write(spark, f"{src}/b", [one, (3, t(2024, 2, 1, 0, 0), 8, "x", 3.0, None)])
    _write(spark, f"{src}/c", [one, (1, t(2024, 1, 1, 10, 5), 8, "x", 8.0, None)])  # another meter's event 1
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    stream_rollup(spark, f"{src}/*", out, ck, batch_bytes=1, width=2, keep_seconds=0)
    got = {(r.household_id, r.timestamp): r.usage for r in read_rollup(spark, out).collect()}
    assert got == {("HH000007", t(2024, 1, 1, 10)): 1.25, ("HH000007", t(2024, 1, 1, 12)): 10.0,
                   ("HH000008", t(2024, 2, 1, 0)): 3.0, ("HH000008", t(2024, 1, 1, 10)): 8.0}
    assert runs.read(spark, f"{out}/ids", COUNTED).count() == 4


def test_many_batches_leave_few_folders(spark, tmp_path):
    folder, n, width = str(tmp_path / "runs"), 40, 3
    for b in range(n):
        runs.merge(spark, folder, ROLLUP, b, merged_hours, width, keep_seconds=0)
        spark.sql(f"SELECT 'HH{b % 2}' AS household_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS timestamp, CAST({b} AS decimal(34,6)) AS usage"
                  ).coalesce(1).write.mode("overwrite").parquet(runs.path_of(folder, b))
    live = runs.current(runs.committed(spark, folder))
    assert [(r.first, r.last) for r in live] == [(0, 26), (27, 35), (36, 38), (39, 39)] or sum(r.size for r in live) == n
    assert len(os.listdir(folder)) < 20
    got = {r.household_id: r.usage for r in read_rollup(spark, folder).collect()}
    assert got == {"HH0": sum(range(0, n, 2)), "HH1": sum(range(1, n, 2))}


def test_incomplete_and_covered_runs_do_not_count(spark, tmp_path):
    folder = str(tmp_path / "runs")
    row = spark.sql("SELECT 'HH1' AS household_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS timestamp, CAST(1 AS decimal(34,6)) AS usage")
    for b in range(4):
        row.write.parquet(runs.path_of(folder, b))
    runs.merge(spark, folder, ROLLUP, 4, merged_hours, width=2)
    assert {"batch=0", "batch=0-1", "batch=0-3"} <= set(os.listdir(folder))  # young runs keep their parts for readers
    assert [r.usage for r in read_rollup(spark, folder).collect()] == [4.0]
    os.remove(f"{folder}/batch=0-3/_SUCCESS")  # a merge that did not end
    assert [r.usage for r in read_rollup(spark, folder).collect()] == [4.0]
    row.write.mode("overwrite").parquet(runs.path_of(folder, 3))  # a batch that is run again
    assert [r.usage for r in read_rollup(spark, folder).collect()] == [4.0]
