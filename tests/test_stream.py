"""K12 streaming rollup: exact under any arrival order, idempotent on restart; live view."""
import datetime as dt
import os
import time

from hydrolens.streaming.rollup import EVENTS_SCHEMA, event_stream, live_hourly, read_rollup, stream_rollup


def _write(spark, path, rows):
    spark.createDataFrame(rows, EVENTS_SCHEMA).coalesce(1).write.parquet(path)


def test_late_events_are_never_lost(spark, tmp_path):
    src = str(tmp_path / "in")
    t = dt.datetime
    _write(spark, f"{src}/a", [(1, t(2024, 1, 1, 10, 5), 7, "x", 1.25, None),
                               (2, t(2024, 1, 1, 12, 30), 7, "x", 2.00, None)])
    time.sleep(1.1)  # the file source orders files by modification time
    _write(spark, f"{src}/b", [(3, t(2024, 1, 1, 10, 15), 7, "x", 5.00, None),   # late: hour 10 again
                               (4, t(2024, 1, 1, 12, 45), 7, "x", 0.50, None)])  # on time: adds to hour 12
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    stream_rollup(spark, f"{src}/*", out, ck, batch_bytes=1)
    got = {r.timestamp: r.usage for r in read_rollup(spark, out).collect()}
    assert got == {t(2024, 1, 1, 10): 6.25, t(2024, 1, 1, 12): 2.5}
    assert len([d for d in os.listdir(out) if d.startswith("batch=") and d != "batch=-1"]) == 2


def test_restart_is_idempotent(spark, tmp_path):
    src = str(tmp_path / "in")
    t = dt.datetime
    _write(spark, f"{src}/a", [(1, t(2024, 1, 1, 10, 5), 3, "x", 1.0, None)])
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    stream_rollup(spark, f"{src}/*", out, ck)
    stream_rollup(spark, f"{src}/*", out, ck)   # nothing new: the checkpoint skips the file
    assert [(r.household_id, r.usage) for r in read_rollup(spark, out).collect()] == [("HH000003", 1.0)]


def test_live_view_on_time_data(spark, tmp_path):
    src = str(tmp_path / "in")
    t = dt.datetime
    _write(spark, f"{src}/a", [(1, t(2024, 1, 1, 10, 5), 7, "x", 1.25, None),
                               (2, t(2024, 1, 1, 10, 55), 7, "x", 2.00, None),
                               (3, t(2024, 1, 1, 11, 30), 8, "x", 4.00, None)])
    got = {}

    def sink(batch, _):
        for r in batch.collect():
            got[(r.household_id, r.timestamp)] = float(r.usage)

    q = (live_hourly(event_stream(spark, f"{src}/*")).writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert got == {("HH000007", t(2024, 1, 1, 10)): 3.25, ("HH000008", t(2024, 1, 1, 11)): 4.0}


def test_folder_of_part_files_and_single_file_and_no_event(spark, tmp_path):
    t = dt.datetime
    rows = [(i, t(2024, 1, 1, i % 5, 5), i % 3, "x", 1.5, None) for i in range(40)]
    spark.createDataFrame(rows, EVENTS_SCHEMA).repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    part = [f for f in os.listdir(tmp_path / "events.parquet") if f.endswith(".parquet")][0]
    for name, path, want in (("folder", f"{tmp_path}/events.parquet", 40),
                             ("file", f"{tmp_path}/events.parquet/{part}", spark.read.parquet(f"{tmp_path}/events.parquet/{part}").count())):
        stream_rollup(spark, path, f"{tmp_path}/{name}", f"{tmp_path}/ck_{name}")
        assert sum(r.usage for r in read_rollup(spark, f"{tmp_path}/{name}").collect()) == 1.5 * want
    spark.createDataFrame([], EVENTS_SCHEMA).write.parquet(f"{tmp_path}/none.parquet")
    stream_rollup(spark, f"{tmp_path}/none.parquet", f"{tmp_path}/empty", f"{tmp_path}/ck_empty")
    assert read_rollup(spark, f"{tmp_path}/empty").count() == 0
