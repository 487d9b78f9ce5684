"""Incremental enrichment: new source files change only the readings that depend on them.

A store is a folder that all executors share:

* ``hourly/v=N/month=yyyy-MM``: hourly sums of the files of instalment N, written once;
* ``readings/v=N/month=yyyy-MM``: the months that instalment N changed, whole. The newest
  version that has a month is the month; older ones are left behind (``drop_old``);
* ``files/v=N``: path, size and time of the source files of instalment N. It is written last:
  an instalment counts once this folder has its ``_SUCCESS``, so one that dies halfway is
  neither seen by readers nor lost, and the next run writes over it.

A reading depends on the 190 hours before it, so a new hour touches its household in its
own month and, near the end, in the next. These (household, month) pairs are enriched anew
with the 190 hours before the month, from the sums of all instalments (an hour may come in
parts). Other households of such a month are copied; other months aren't read.

Defined results: rows without household or time are left out, NULL litres add nothing; no new
file changes nothing; a source file that changed after it was read is an error. One writer
at a time.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens.functions.columns import month_of
from hydrolens.operators.enrich import CONT_HOURS, ROLL_HOURS, enrich
from hydrolens.session import hadoop_path, path_exists
from hydrolens.schema import READINGS
from hydrolens.sources.readers import read_readings
from hydrolens.sources.writers import write_readings

#: Hours before a reading that it depends on; less than the shortest month.
REACH = (ROLL_HOURS - 1) + (CONT_HOURS - 1)
_FILES = "path string, length long, modificationTime timestamp"


def _names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Values of the ``prefix=value`` folders of ``path``."""
    if not path_exists(spark, path):
        return []
    fs, p = hadoop_path(spark, path)
    names = (s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
    return sorted(n.removeprefix(f"{prefix}=") for n in names if n.startswith(f"{prefix}="))


def versions(spark: SparkSession, store: str) -> list[int]:
    """Finished instalments, oldest first."""
    return [int(v) for v in _names(spark, f"{store}/files", "v") if path_exists(spark, f"{store}/files/v={v}/_SUCCESS")]


def _folders(spark: SparkSession, store: str, kind: str) -> dict[str, list[str]]:
    """Folders of each month in finished instalments, oldest first: as many names as instalments changed it."""
    out: dict[str, list[str]] = {}
    for v in versions(spark, store):
        for month in _names(spark, f"{store}/{kind}/v={v:06d}", "month"):
            out.setdefault(month, []).append(f"{store}/{kind}/v={v:06d}/month={month}")
    return out


def read_store(spark: SparkSession, store: str, months: set[str] | None = None) -> DataFrame:
    """The readings of the store (or of some months): the newest folder of each month."""
    newest = [paths[-1] for month, paths in _folders(spark, store, "readings").items() if months is None or month in months]
    if not newest:
        return spark.createDataFrame([], READINGS)
    return read_readings(spark, newest, "parquet", trusted=True)


def new_files(spark: SparkSession, source: str, store: str) -> list[str]:
    """Parquet files below ``source`` that no instalment has read; only names, sizes and times are read.

    The list goes into the scan of the instalment, whose file index holds it anyway.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(
        source).select("path", "length", "modificationTime")
    seen = [f"{store}/files/v={v:06d}" for v in versions(spark, store)]
    known = spark.read.schema(_FILES).parquet(*seen) if seen else spark.createDataFrame([], _FILES)
    changed = found.join(known.select("path", F.col("length").alias("l"), F.col("modificationTime").alias("m")), "path").where(
        (F.col("length") != F.col("l")) | (F.col("modificationTime") != F.col("m")))
    if not changed.isEmpty():
        raise ValueError(f"{changed.first().path} changed after it was read: build the store anew")
    return [r.path for r in found.join(known, "path", "left_anti").select("path").sort("path").toLocalIterator()]


def _later(hours: int) -> Column:
    return month_of(F.col("timestamp") + F.make_dt_interval(hours=F.lit(hours)))


def touched(hourly: DataFrame) -> DataFrame:
    """(household, month) pairs with readings that depend on these hours."""
    months = F.array_distinct(F.array(month_of("timestamp"), _later(REACH)))
    return hourly.select("household_id", F.explode(months).alias("month")).distinct()


def add_files(spark: SparkSession, source: str, store: str, hourly: Callable[[DataFrame], DataFrame]) -> list[str]:
    """One instalment: read the new files of ``source``, enrich what they touch. Returns the changed months.

    ``hourly`` turns source rows into (household_id, timestamp, usage) sums by hour.
    """
    paths = new_files(spark, source, store)
    if not paths:
        return []
    v = max(versions(spark, store), default=0) + 1
    at = {kind: f"{store}/{kind}/v={v:06d}" for kind in ("hourly", "pairs", "readings", "files")}
    sums = hourly(spark.read.parquet(*paths)).where(F.col("household_id").isNotNull() & F.col("timestamp").isNotNull())
    (sums.select("household_id", "timestamp", "usage", month_of("timestamp").alias("month")).hint("rebalance", "month")
     .write.mode("overwrite").partitionBy("month").parquet(at["hourly"]))
    new = _names(spark, at["hourly"], "month")
    if new:
        touched(spark.read.parquet(*[f"{at['hourly']}/month={m}" for m in new])).write.mode("overwrite").parquet(at["pairs"])
        pairs = spark.read.parquet(at["pairs"])
        months = {r.month for r in pairs.select("month").distinct().collect()}  # months of one instalment
        before = {r.m for r in pairs.select(F.date_format(F.add_months(F.to_date("month", "yyyy-MM"), -1), "yyyy-MM").alias("m"))
                  .distinct().collect()}
        old = _folders(spark, store, "hourly")
        parts = [p for m in sorted(months | before) for p in old.get(m, []) + ([f"{at['hourly']}/month={m}"] if m in new else [])]
        raw = spark.read.parquet(*parts).withColumn("_month", F.explode(
            F.array_distinct(F.array(month_of("timestamp"), _later(REACH)))))
        needed = raw.join(pairs.withColumnRenamed("month", "_month"), ["household_id", "_month"], "left_semi")
        # an hour of two touched months comes twice: once is enough
        whole = needed.withColumn("_own", F.col("_month") == month_of("timestamp")).groupBy("household_id", "timestamp").agg(
            F.sum(F.when(F.col("_own"), F.col("usage"))).alias("own"), F.sum(F.when(~F.col("_own"), F.col("usage"))).alias("halo"))
        kind = dict(raw.dtypes)["usage"]
        fresh = enrich(whole.select("household_id", "timestamp", F.coalesce("own", "halo").cast(kind).alias("usage")))
        keyed = lambda r: r.withColumn("month", month_of("timestamp"))
        kept = keyed(read_store(spark, store, months)).join(pairs, ["household_id", "month"], "left_anti")
        changed = keyed(fresh).join(pairs, ["household_id", "month"], "left_semi")
        write_readings(changed.unionByName(kept).select(*READINGS.fieldNames()), at["readings"])
    (spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
     .write.mode("overwrite").parquet(at["files"]))
    return _names(spark, at["readings"], "month")


def drop_old(spark: SparkSession, store: str) -> int:
    """Delete readings folders that a newer version has replaced (once no query reads them); how many."""
    old = [p for paths in _folders(spark, store, "readings").values() for p in paths[:-1]]
    for path in old:
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)
    return len(old)
