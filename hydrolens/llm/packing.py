"""Packing along a space-filling curve: neighbours in content share training sequences.

A document's token counts are hashed to a few hundred dimensions and projected to
three; its place on a Hilbert curve through that cube is its sort key. All
documents are range-sorted by the key, and the row of ids that results is cut
every ``length`` ids. A range's first position is a prefix sum over the ranges,
so sequences run across range borders and only the very last one is padded.

The key ends in bits of a hash of the document id: copies, which share a place on
the curve, still spread over ranges.

Defined results: a NULL or empty text is the end id alone; a NULL document id
sorts first among equals; repeated rows are packed as often as they occur; an
empty table gives no pieces; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolens.llm.common import encoder, not_null_key, parts_for, range_splits, rows_of, with_range

LENGTH = 1024
HASHED = 256
AXES = 3
BITS = 15
TIE_BITS = 18
RANGE_TOKENS = 32 << 20
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def projection(hashed: int = HASHED, axes: int = AXES, seed: int = 11) -> np.ndarray:
    """Orthonormal columns, the same in every process."""
    return np.linalg.qr(np.random.RandomState(seed).standard_normal((hashed, axes)))[0]


def hashed_vector(ids: np.ndarray, hashed: int = HASHED) -> np.ndarray:
    """Unit vector of damped counts of the ids, each dealt to one dimension by a multiplicative hash."""
    dims = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - (hashed - 1).bit_length())
    v = np.log1p(np.bincount(dims, minlength=hashed)[:hashed])
    return v / max(np.linalg.norm(v), 1e-12)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of whole numbers below ``2 ** bits``.

    Works on all rows at once: from the highest bit down, each axis either flips
    the lower bits of the first axis or swaps them with its own, then the axes are
    turned into a Gray code whose interleaved bits are the position.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for a in range(axes):
            on = (x[a] >> b & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[a]) & low)
            x[0] ^= np.where(on, low, swap)
            x[a] ^= swap
    for a in range(1, axes):
        x[a] ^= x[a - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in range(axes):
            key = key << 1 | (x[a] >> b & 1)
    return key


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    at = np.clip((vectors @ projection() + 1) / 2, 0, 1 - 2.0 ** -BITS)
    return hilbert_keys((at * (1 << BITS)).astype(np.int64))


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            flat = [x + end for x in enc.encode(b.column("text").to_pylist())]
            if not flat:
                continue
            keys = curve_keys(np.array([hashed_vector(np.frombuffer(x, enc.dtype)) for x in flat]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(keys << TIE_BITS), pa.array([len(x) // enc.dtype.itemsize for x in flat], pa.int64()),
                 pa.array(flat, pa.binary())], names=["doc_id", "curve", "doc_tokens", "flat"])
    return run


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``key`` (place on the curve, then a hash of the id), ``doc_tokens`` and ``flat`` (the ids)."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_encode(tokenizer, end_id), "doc_id long, curve long, doc_tokens long, flat binary").select(
        "doc_id", (F.col("curve") + F.pmod(F.xxhash64("doc_id"), F.lit(1 << TIE_BITS))).alias("key"), "doc_tokens", "flat")


def _cut(base: dict[int, int], length: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = None, 0
        for b in batches:
            out: list[tuple] = []
            for p, doc, flat in rows_of([b], "part", "doc_id", "flat"):
                if p != part:
                    part, at = p, base[p]
                ids = np.frombuffer(flat, width).astype("<u4")
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(at, length)
                    n = min(length - offset, len(ids) - start)
                    out.append((doc, start, n, len(ids), sequence, offset, ids[start:start + n].tobytes()))
                    start, at = start + n, at + n
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:-1]] + [pa.array([o[-1] for o in out], pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
    return run


def pack(docs: DataFrame, tokenizer: str, scratch: str, length: int = LENGTH, end_id: int = 0, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """The pieces of all documents: where each lies in its document and in its sequence, and its ids (32 bits each).

    ``scratch``: folder in the shared store for the encoded documents, which are
    encoded once and read twice (sizes of the ranges, then the pieces).
    """
    spark = docs.sparkSession
    encoded(docs, tokenizer, end_id, doc_id, text).write.option("compression", "zstd").parquet(scratch)
    rows = spark.read.parquet(scratch)
    n = parts_for(rows, rows.agg(F.sum("doc_tokens")).first()[0] or 0, RANGE_TOKENS)
    splits = range_splits(rows, "key", n, weight="doc_tokens")
    sizes = with_range(rows.select("key", "doc_tokens"), "key", splits, "part").groupBy("part").agg(
        F.sum("doc_tokens").alias("n"))
    base, total = {}, 0
    for r in sorted(sizes.collect()):  # a row for each range
        base[r.part], total = total, total + r.n
    width = encoder(tokenizer).dtype.str
    placed = with_range(rows, "key", splits, "part").repartitionById(n, "part").sortWithinPartitions(
        "part", "key", not_null_key("doc_id"), F.crc32("flat")).select("part", "doc_id", "flat")
    return placed.mapInArrow(_cut(base, length, width), PIECES)
