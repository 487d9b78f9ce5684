"""Session helpers: a local session for tests/bench and the shared scratch area."""
from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_scratch: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "hydrolens") -> SparkSession:
    """Session used by tests and bench.py. On a cluster the caller owns the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for materialised tables and checkpoints.

    Taken from the session: the configured ``spark.checkpoint.dir`` (stable
    across applications, so materialised tables are reused), else the context's
    checkpoint dir. Where neither is set, a local session gets a folder of its
    own (its executors are this very process); any other session is refused,
    since executors would write to disks that nobody else can read.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            d = None
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="hydrolens-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the shared folder, in this application's scratch, which is removed when Python ends."""
    scratch = stable_path(spark, f"scratch-{spark.sparkContext.applicationId}")
    if scratch not in _scratch:
        _scratch.add(scratch)
        atexit.register(_remove, spark, scratch)
    return "/".join([scratch, *parts, uuid.uuid4().hex])


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - Hadoop FS has no public Python API
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001
    except Exception:  # noqa: BLE001 - the session may be gone; scratch of a stopped application is harmless
        pass


def stable_path(spark: SparkSession, *parts: str) -> str:
    base = shared_dir(spark).rstrip("/")
    return "/".join([base, "hydrolens", *parts])


def hadoop_path(spark: SparkSession, path: str):
    """File system and path object of any shared file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - Hadoop FS access has no public Python API
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p  # noqa: SLF001


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through Hadoop FS, so it works for any shared filesystem."""
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def tune_for_scale(spark: SparkSession, input_bytes: int, total_cores: int | None = None,
                   target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Size shuffle and scan partitions from the input size (runtime SQL confs only).

    Shuffle partitions ~ input / 256 MB (at least 2 per core) so a partition's
    shuffle block fits executor memory; AQE then coalesces small ones and
    splits skewed ones. Broadcasts stay behind the default 10 MB runtime size
    check of AQE; nothing is forced above it.
    """
    cores = total_cores or spark.sparkContext.defaultParallelism
    parts = max(2 * cores, -(-input_bytes // target_partition_bytes))
    conf = {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(min(target_partition_bytes, 1 << 30)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
