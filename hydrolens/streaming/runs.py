"""A table that grows by numbered micro-batches, kept in few folders.

Batch ``n`` writes the folder ``batch=n``. Each ``width`` neighbouring batches are
merged into one run, ``batch=first-last``; each ``width`` runs of that size into a
larger one, and so on. After N batches some ``width * log(N)`` folders are left, and
a row is written again once for each size.

A folder counts once it holds ``_SUCCESS``, which Spark's committer writes last, so
a merged run comes into view as a whole. Readers take each batch from the largest
run that holds it. Folders that a run stands for are removed when that run is older
than ``keep_seconds``, which is what a reader has to finish in.
"""
from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hydrolens.sources.store import hadoop_fs

#: Runs of one size that become one.
WIDTH = 16
KEEP_SECONDS = 3600.0
_NAME = re.compile(r"batch=(-?\d+)(?:-(\d+))?")


@dataclass(frozen=True)
class Run:
    """The batches ``first`` to ``last`` in one folder, complete since ``made`` (seconds)."""

    first: int
    last: int
    path: str
    made: float

    @property
    def size(self) -> int:
        return self.last - self.first + 1


def path_of(folder: str, first: int, last: int | None = None) -> str:
    return f"{folder}/batch={first}" + (f"-{last}" if last is not None and last != first else "")


def committed(spark: SparkSession, folder: str, before: int | None = None) -> list[Run]:
    """All complete runs in a folder, those of batches from ``before`` on left out."""
    fs, root = hadoop_fs(spark, folder)
    if not fs.exists(root):
        return []
    found = []
    for entry in fs.listStatus(root):
        path = entry.getPath().toString()
        named = _NAME.fullmatch(entry.getPath().getName())
        done = hadoop_fs(spark, f"{path}/_SUCCESS")[1]
        if named and fs.exists(done):
            found.append(Run(int(named[1]), int(named[2] or named[1]), path,
                             fs.getFileStatus(done).getModificationTime() / 1000))
    return [r for r in found if before is None or r.last < before]


def current(runs: list[Run]) -> list[Run]:
    """The runs that hold each batch once: those that no larger run stands for."""
    out: list[Run] = []
    for r in sorted(runs, key=lambda r: (r.first, -r.last)):
        if not out or r.first > out[-1].last:
            out.append(r)
    return out


def read(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> DataFrame | None:
    """The rows of all batches (before one); None where there is no batch."""
    paths = [r.path for r in current(committed(spark, folder, before))]
    return spark.read.schema(schema).parquet(*paths) if paths else None


def merge(spark: SparkSession, folder: str, schema: str, before: int, combine: Callable[[DataFrame], DataFrame],
          width: int = WIDTH, keep_seconds: float = KEEP_SECONDS) -> None:
    """Merge the batches before ``before`` where ``width`` runs of one size are complete.

    ``combine`` makes the rows of a merged run of its parts' rows. Called for one
    batch at a time, before that batch writes: what it merges does not change any more.
    """
    runs = committed(spark, folder, before)
    live = current(runs)
    for r in set(runs) - set(live):
        over = next(x for x in live if x.first <= r.first and r.last <= x.last)
        if time.time() - over.made >= keep_seconds:
            fs, p = hadoop_fs(spark, r.path)
            fs.delete(p, True)
    size = 1
    while any(r.size >= size for r in live):
        blocks: dict[int, list[Run]] = {}
        for r in live:
            if r.size == size:
                blocks.setdefault(r.first // (size * width), []).append(r)
        for parts in blocks.values():
            if len(parts) == width:
                first, last = parts[0].first, parts[-1].last
                rows = spark.read.schema(schema).parquet(*[r.path for r in parts])
                made = path_of(folder, first, last)
                combine(rows).write.mode("overwrite").parquet(made)
                live = [r for r in live if r not in parts] + [Run(first, last, made, time.time())]
        size *= width
