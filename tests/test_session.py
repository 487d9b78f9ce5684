"""Session helpers and large household filters."""
import shutil

import pytest
from pyspark.sql import functions as F

from hydrolens.operators import filters as C
from hydrolens.session import shared_dir, tune_for_scale


def test_shared_dir_comes_from_session(spark):
    d = shared_dir(spark)
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        assert d == conf
    assert spark.sparkContext.getCheckpointDir()


def test_tune_for_scale_sizes_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        conf = tune_for_scale(spark, 100 << 40, total_cores=8000)     # 100 TB
        assert int(conf["spark.sql.shuffle.partitions"]) == 409600     # 256 MB each
        conf = tune_for_scale(spark, 10 << 20, total_cores=8)          # tiny: 2 per core
        assert int(conf["spark.sql.shuffle.partitions"]) == 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_household_list(spark, h1):
    ids = [f"HH{i:06d}" for i in range(5000)]
    out = C.global_filter(h1, households=ids)
    assert out.count() == h1.count()
    ids_df = spark.createDataFrame([("HH000002",)], "household_id string")
    assert C.global_filter(h1, households=ids_df).select("household_id").distinct().count() == 1
    assert C.global_filter(h1, households=ids_df).where(F.col("household_id") != "HH000002").count() == 0


class _Cluster:
    """Stands for a session on a cluster without a shared folder."""

    class sparkContext:  # noqa: N801
        master = "spark://head:7077"
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k, d: d)}))
        getCheckpointDir = staticmethod(lambda: None)

    class conf:  # noqa: N801
        get = staticmethod(lambda k: None)


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Cluster)


def test_changed_input_is_seen_and_gone_folder_rebuilt(spark, tmp_path):
    from hydrolens.sources.store import fingerprint, materialize
    spark.range(3).write.parquet(f"{tmp_path}/t")
    before = fingerprint(spark, f"{tmp_path}/t")
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/t")
    assert fingerprint(spark, f"{tmp_path}/t") != before
    key = str(tmp_path)
    one = materialize(spark, "test_table", key, lambda: spark.range(7))
    shutil.rmtree(one.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0])
    assert materialize(spark, "test_table", key, lambda: spark.range(7)).count() == 7
