"""Line dedup by distinct-site spread: lines found on many sites are boilerplate.

Each line's sites go into a HyperLogLog sketch; sketches merge by aggregation, so
a line that half the corpus shares costs a task one sketch. Lines whose estimate
lies near the threshold get an exact distinct count, the others are decided by
their sketch. A boilerplate line stays at its first place (smallest document id)
and goes everywhere else. DataFrame operations only.

Any corpus repeats lines of a few words by chance, on every site once it is large
enough. They are judged by their share as well: a line of fewer than ``SHORT`` words
must also be found once in ``SHARE`` documents or more often.

Defined results: lines are told apart by their text without white space at either
end; blank lines are no lines, and stay. A NULL site counts as no site. A NULL or
empty text stays as it is; a NULL document id sorts first. A document that would
lose four fifths of its characters or more (of lines without white space at either
end) is a copy rather than a page with boilerplate: it stays whole, for near-duplicate
removal, whose similarity that is, to judge. Repeated rows are treated alike. An empty table
gives an empty result. Extra columns pass through; input columns named as the two
counts are replaced.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens.llm.common import not_null_key

#: Sites from which on a line is boilerplate.
MIN_SITES = 8
#: Lines of fewer words are boilerplate only if there is one for each so many documents.
SHORT, SHARE = 5, 20
#: Registers of a sketch, as a power of two.
LG_K = 10
SPACE = " \t\n\x0b\f\r"


def near(min_sites: int, lg_k: int = LG_K) -> tuple[float, float]:
    """Estimates between these are counted again: four standard errors of the sketch, one site at least."""
    error = max(1.0, 4 * 1.04 / math.sqrt(1 << lg_k) * min_sites)
    return min_sites - error, min_sites + error


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def places(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """A row for each line that isn't blank: document (id and text hash), position, site and line hash."""
    rows = docs.select(not_null_key(doc_id).alias("k"), F.xxhash64(text).alias("t"),
                       F.col(site).cast("string").alias("site"), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
    line = F.btrim("line", F.lit(SPACE))
    few = F.size(F.split(line, f"[{SPACE}]+")) < SHORT
    return rows.where(line != "").select("k", "t", "pos", "site", F.xxhash64(line).alias("h"), few.alias("short"))


def boilerplate(lines: DataFrame, scratch: str, n_docs: Column, min_sites: int = MIN_SITES) -> DataFrame:
    """Hash (``h``) and first place (``first``) of each line on at least ``min_sites`` distinct sites;
    of ``n_docs`` documents, a short one's share must be large enough too."""
    low, high = near(min_sites)
    spread = lines.groupBy("h").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"),
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "t", "pos")).alias("first"), F.max("short").alias("short"))
    often = ~F.col("short") | (F.col("n") * SHARE >= n_docs)
    spread.where((F.col("n") >= min_sites) & (F.col("sites") >= low) & often).write.parquet(scratch)
    spread = lines.sparkSession.read.parquet(scratch)
    close = spread.where(F.col("sites") <= high).select("h")
    exact = (lines.join(close, "h", "left_semi").where(F.col("site").isNotNull()).groupBy("h", "site").count()
             .groupBy("h").agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= min_sites).select("h"))
    return spread.where(F.col("sites") > high).select("h", "first").unionByName(
        spread.join(exact, "h").select("h", "first"))


def dedup_lines(docs: DataFrame, scratch: str, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text",
                site: str = "source", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, ``n_lines`` (before) and ``n_removed``.

    ``scratch``: folder in the shared store; the line hashes are written there once
    and read for the sketches, the exact counts and the removal. ``counts``: other names
    for the two counts.
    """
    n_lines, n_removed = counts
    spark = docs.sparkSession
    places(docs, doc_id, text, site).write.parquet(f"{scratch}/lines")
    lines = spark.read.parquet(f"{scratch}/lines")
    found = boilerplate(lines, f"{scratch}/spread", docs.agg(F.count(F.lit(1))).scalar(), min_sites)
    key = {"__doc": not_null_key(doc_id), "__text": F.xxhash64(text)}
    gone = (lines.join(found, "h").where(F.struct("k", "t", "pos") != F.col("first"))
            .groupBy(F.col("k").alias("__doc"), F.col("t").alias("__text")).agg(F.collect_set("pos").alias("__gone")))
    rows = docs.drop(*(set(counts) - {doc_id, text, site})).withColumns(key).join(gone, list(key), "left")
    all_lines = _lines(F.col(text))
    full = F.coalesce(F.size(F.filter(all_lines, lambda x: F.btrim(x, F.lit(SPACE)) != "")), F.lit(0))
    lost = F.coalesce(F.size("__gone"), F.lit(0))
    every = F.sequence(F.lit(0), F.size("__all") - 1)
    stay = F.array_except(every, F.col("__gone"))
    cut = F.array_join(F.transform(stay, lambda i: F.get(F.col("__all"), i)), "\n")
    rows = rows.withColumns({"__all": F.when(F.col("__gone").isNotNull(), all_lines), n_lines: full.cast("bigint")})
    chars = lambda at: F.aggregate(at, F.lit(0).cast("bigint"), lambda n, i: n + F.length(
        F.btrim(F.get(F.col("__all"), i), F.lit(SPACE))))
    some = (lost > 0) & (5 * chars(F.col("__gone")) < 4 * chars(every))
    rows = rows.withColumns({n_removed: F.when(some, lost).otherwise(F.lit(0)).cast("bigint"),
                             "__cut": F.when(some, cut).otherwise(F.col(text))})
    return rows.withColumn(text, F.col("__cut")).drop(*key, "__all", "__gone", "__cut")
