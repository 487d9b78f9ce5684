"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes sets chunk borders wherever its low bits are all
ones, so borders move with the content. Each chunk gives one letter; a
fingerprint holds the letters at the smallest block size that gives at most 64
chunks, and at twice that size. Fingerprints of one block size, or of sizes a
factor of two apart, are compared by edit distance. The whole text counts,
however long; the rolling hash is computed for all places of a text at once.

Defined results: a NULL or empty text has the fingerprint ``0::``. Equal texts
have equal fingerprints. Rows of one document id are ordered by a hash of their
texts; a NULL id sorts first; the document after the last is the first, so a table
of one document compares it with itself; an empty table gives an empty result.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens.llm.common import not_null_key, parts_for, range_splits, rows_of, with_range

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW = 7
MOST = 64
LEAST_LEVEL = 3
RANGE_DOCS = 50_000


def _rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the last seven bytes at every place; fewer bytes at the start."""
    h = np.zeros(len(data), np.uint32)
    for age in range(min(WINDOW, len(data))):
        factor = np.uint32(pow(0x01000193, age + 1, 1 << 32))
        h[age:] += (data[:len(data) - age].astype(np.uint32) + np.uint32(1)) * factor
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


def _letters(raw: bytes, borders: np.ndarray) -> str:
    cuts = [0, *(borders + 1).tolist()]
    if cuts[-1] < len(raw):
        cuts.append(len(raw))
    return "".join(LETTERS[zlib.crc32(raw[a:b]) & 63] for a, b in pairwise(cuts))


def fingerprint(text: str | None) -> str:
    """``level:letters:letters`` with block size ``2 ** level`` and twice that."""
    if not text:
        return "0::"
    raw = text.encode()
    h = _rolling(np.frombuffer(raw, np.uint8))
    level = LEAST_LEVEL
    places = np.flatnonzero((h & np.uint32((1 << level) - 1)) == (1 << level) - 1)
    found = h[places]
    while len(places) >= MOST and level < 31:
        level += 1
        on = (found & np.uint32((1 << level) - 1)) == (1 << level) - 1
        places, found = places[on], found[on]
    on = (found & np.uint32((1 << (level + 1)) - 1)) == (1 << (level + 1)) - 1
    return f"{level}:{_letters(raw, places)}:{_letters(raw, places[on])}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one less the edit distance's share of the longer signature, at the best block size both have."""
    x, y = F.split(a, ":"), F.split(b, ":")
    gap = x[0].cast("int") - y[0].cast("int")

    def score(s: Column, t: Column) -> Column:
        longest = F.greatest(F.length(s), F.length(t))
        return F.when(longest == 0, 0.0).otherwise(1 - F.levenshtein(s, t) / longest)

    return (F.when(a == b, 1.0).when(gap == 0, F.greatest(score(x[1], y[1]), score(x[2], y[2])))
            .when(gap == 1, score(x[1], y[2])).when(gap == -1, score(x[2], y[1])).otherwise(0.0))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``, of every whole text."""
    out = docs.drop("fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([fingerprint(t) for t in b.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, "fingerprint"])
    return out.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in out.dtypes)}, fingerprint string")


def _edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in ranges, each ended by a copy of the next range's first row (``guest``)."""
    last, out, size = None, [], 0

    def made() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[
            "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "next_fingerprint"])

    for b in batches:
        for part, guest, doc, text in rows_of([b], "part", "guest", "doc_id", "text"):
            text = text or ""
            mark = fingerprint(text)
            if last and last[0] == part:
                changed = _edited(last[2], text)
                out.append((last[1], len(last[2]), changed, last[3], fingerprint(changed), mark))
                size += len(changed)
            last = None if guest else (part, doc, text, mark)
            if size > 8 << 20:
                yield made()
                out, size = [], 0
    if out:
        yield made()


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its fingerprint, its ``edited`` text's, and that of the next document in order of ids.

    The edited text ends in the start of the next document's in place of its own
    last quarter. Documents are dealt to ranges of ids; the first row of a range is
    also sent, as a guest, to the range before it.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"),
                       not_null_key(doc_id).alias("k"), F.xxhash64(text).alias("h"))
    n = parts_for(docs, docs.count(), RANGE_DOCS)
    splits = range_splits(rows, "k", n)
    firsts = with_range(rows.select("k", "h"), "k", splits, "part").groupBy("part").agg(F.min(F.struct("k", "h")).alias("f"))
    found = sorted((r.part, r.f.k, r.f.h) for r in firsts.collect())  # a row for each range
    rows = with_range(rows, "k", splits, "part")
    goes = F.array(F.col("part"))
    if found:
        by_part = {part: (before, k, h) for (part, k, h), (before, _, _) in zip(found, [found[-1], *found], strict=False)}
        before, k, h = (F.get(F.lit([by_part.get(p, (0, 0, 0))[i] for p in range(len(splits) + 1)]), F.col("part"))
                        for i in range(3))
        goes = F.when((F.col("k") == k) & (F.col("h") == h), F.array(F.col("part"), (-1 - before).cast("int"))).otherwise(goes)
    placed = rows.withColumn("to", F.explode(goes)).select(
        "doc_id", "text", "k", "h", (F.col("to") < 0).alias("guest"),
        F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("part"))
    placed = placed.repartitionById(n, "part").sortWithinPartitions("part", "guest", "k", "h")
    return placed.select("part", "guest", "doc_id", "text").mapInArrow(
        _neighbours, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, next_fingerprint string")
