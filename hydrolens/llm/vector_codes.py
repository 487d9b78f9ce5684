"""Vector code compression: product codes by a lexicographic trie over each batch's distinct parts.

Components become whole numbers, floor(scale * x), and vectors are cut into equal
parts with a codebook each. The distinct parts of a batch, sorted, are the leaves of
a trie whose levels are dimensions. A depth-first traversal carries the squared
distances to all entries down: what a common prefix of dimensions has gathered is
computed once for all parts below it. Subtrees of at most ``BLOCK`` leaves are
walked a level at a time in one array. Leaves take the nearest entry, and add
themselves, weighted by how often they occur, to its sums.

A round is one pass: every task sends one row for each entry it met, so nothing the
size of the data is shuffled, and the codebooks (entries x dimensions) are all the
driver sees. Arithmetic is exact: 64-bit numbers where they suffice, else Python's.

Defined results: dropped are rows whose vector is NULL, empty, holds NULL or a
component that isn't finite, can't be cut into equal parts, or differs in length from
that of the smallest kept id. Fewer kept rows than entries give smaller codebooks;
NULL ids come last and rows of one id in the order of their vectors; repeated rows
are coded each; an error, or a label's sum, beyond 64 bits is NULL; no kept rows give
an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Leaves of a subtree that is walked a level at a time: it bounds the distances held at once.
BLOCK = 4096
_LONG = (1 << 63) - 1

#: A part's entries, in order; each a row of whole numbers.
Codebook = list[list[int]]


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles: 64-bit numbers if they're small, else Python's."""
    if not x.size or np.abs(x).max() * scale < 1 << 52:
        return np.floor(x * scale).astype(np.int64)
    def exact(v: float) -> int:
        n, d = v.as_integer_ratio()
        return n * scale // d
    return np.array([[exact(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, the place of every row among them, and how often each occurs."""
    if parts.dtype == object:
        order = np.array(sorted(range(len(parts)), key=lambda i: tuple(parts[i])), np.int64)
    else:
        order = np.lexsort(parts.T[::-1])
    rows = parts[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    return rows[new], place, np.bincount(place)


def nearest(leaves: np.ndarray, entries: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the first of equals) and squared distance of each leaf; leaves are distinct and sorted."""
    n, dims = leaves.shape
    codes, errors = np.zeros(n, np.int64), np.zeros(n, leaves.dtype)
    shared = np.zeros(n, np.int64)  # leading dimensions that a leaf has in common with the one before it
    shared[1:] = (leaves[1:] != leaves[:-1]).argmax(axis=1)

    def branches(lo: int, hi: int, depth: int) -> np.ndarray:
        """First leaves of the nodes that a level has among these leaves."""
        return np.concatenate([[lo], lo + 1 + np.flatnonzero(shared[lo + 1:hi] <= depth)])

    def subtree(lo: int, hi: int, depth: int, gathered: np.ndarray) -> None:
        at, first = gathered[None], np.array([lo])
        for j in range(depth, dims):
            start = branches(lo, hi, j)
            above = np.searchsorted(first, start, "right") - 1
            at, first = at[above] + (entries[:, j] - leaves[start, j][:, None]) ** 2, start
        codes[lo:hi] = at.argmin(axis=1)
        errors[lo:hi] = at[np.arange(hi - lo), codes[lo:hi]]

    def visit(lo: int, hi: int, depth: int, gathered: np.ndarray) -> None:
        if hi - lo <= block or depth == dims:
            subtree(lo, hi, depth, gathered)
            return
        starts = branches(lo, hi, depth)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), hi], strict=True):
            visit(a, b, depth + 1, gathered + (entries[:, depth] - leaves[a, depth]) ** 2)

    if n:
        visit(0, n, 0, np.zeros(len(entries), leaves.dtype))
    return codes, errors


def _fitting(parts: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Parts and entries in 64 bits where all distances and sums fit, else in Python's numbers."""
    most = max((abs(v) for row in book for v in row), default=0)
    if parts.dtype != object and parts.size:
        most = max(most, int(np.abs(parts).max()))
    small = parts.dtype != object and (2 * most) ** 2 * max(1, parts.shape[1]) <= _LONG and most * max(1, len(parts)) <= _LONG
    kind = np.int64 if small else object
    return parts.astype(kind), np.array(book, kind)


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return whole(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))


def _sums(books: list[Codebook], dims: int):
    """For each task: how many of its parts each entry is nearest to, and their sums."""
    step = dims // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            x = _matrix(b, dims)
            for p, book in enumerate(books):
                parts, entries = _fitting(x[:, p * step:(p + 1) * step], book)
                leaves, _, weight = distinct(parts)
                codes, _ = nearest(leaves, entries)
                count, total = np.zeros(len(book), np.int64), np.zeros(entries.shape, entries.dtype)
                np.add.at(count, codes, weight)
                np.add.at(total, codes, leaves * weight[:, None].astype(entries.dtype))
                for e in np.flatnonzero(count).tolist():
                    row = [int(count[e]), *map(int, total[e])]
                    met[p, e] = [a + b for a, b in zip(met[p, e], row, strict=True)] if (p, e) in met else row
        yield _sum_rows(met)
    return run


def _sum_rows(met: dict[tuple[int, int], list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p for p, _ in met], pa.int32()), pa.array([e for _, e in met], pa.int32()),
         pa.array([",".join(map(str, v)) for v in met.values()], pa.string())], names=["part", "entry", "sums"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All tasks' sums of an entry added up; Python's numbers, as decimal digits, have no bounds."""
    met: dict[tuple[int, int], list[int]] = {}
    for b in batches:
        for p, e, sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
            row = [int(v) for v in sums.split(",")]
            met[p, e] = [a + b for a, b in zip(met[p, e], row, strict=True)] if (p, e) in met else row
    yield _sum_rows(met)


def _coded(books: list[Codebook], dims: int):
    step = dims // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, dims)
            codes, errors = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), object)
            for p, book in enumerate(books):
                parts, entries = _fitting(x[:, p * step:(p + 1) * step], book)
                leaves, place, _ = distinct(parts)
                found, far = nearest(leaves, entries)
                codes[:, p] = found[place]
                errors += far[place].astype(object)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), pa.array([bytes(c).hex() for c in codes]),
                 pa.array([int(e) if e <= _LONG else None for e in errors], pa.int64())],
                names=["vec_id", "label", "code", "error"])
    return run


def kept_vectors(rows: DataFrame, scratch: str, parts: int = PARTS, vec_id: str = "vec_id", vector: str = "embedding",
                 label: str = "label") -> DataFrame:
    """The rows that can be coded, as ``vec_id``, ``vector`` (doubles) and ``label``, written once."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("vector"), F.col(label).alias("label")).where(
        finite & (F.size(v) > 0) & (F.size(v) % parts == 0)).write.parquet(scratch)
    return rows.sparkSession.read.parquet(scratch)


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[Codebook], int]:
    """The parts' codebooks, begun with the vectors of the smallest ids, and the vectors' length (0 if there is none)."""
    ascending = [F.asc_nulls_last("vec_id"), F.asc("vector")]
    smallest = kept.orderBy(*ascending).first()
    dims = len(smallest.vector) if smallest else 0
    alike = kept.where(F.size("vector") == dims)
    first = whole(np.array([r.vector for r in alike.orderBy(*ascending).limit(entries).collect()]).reshape(-1, dims or 1))
    step = dims // parts
    books = [[[int(x) for x in row[p * step:(p + 1) * step]] for row in first] for p in range(parts)]
    vectors = alike.select("vector")
    n = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(rounds if dims else 0):
        sums = vectors.mapInArrow(_sums(books, dims), "part int, entry int, sums string")
        sums = sums.repartition(n, "part", "entry").mapInArrow(_merged, "part int, entry int, sums string")
        for r in sums.collect():  # parts x entries rows
            count, *total = (int(v) for v in r.sums.split(","))
            books[r.part][r.entry] = [t // count for t in total]
    return books, dims


def books_sha256(books: list[Codebook]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for row in book for v in row).encode()).hexdigest()


def compress(rows: DataFrame, scratch: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[Codebook]]:
    """``vec_id``, ``label``, ``code``, ``error`` and ``label_error`` of every kept row, and the final codebooks.

    ``scratch``: folder in the shared store for the kept rows, their codes and the
    labels' sums. These are written before they are joined: the join then has a plain
    exchange on both sides, which Spark broadcasts or splits by its measured size.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes are one byte: 1 to 256 entries")
    kept = kept_vectors(rows, f"{scratch}/kept", parts, vec_id, vector, label)
    books, dims = fit(kept, parts, entries, rounds)
    spark, kind = rows.sparkSession, kept.schema["label"].dataType.simpleString()
    if not dims:
        return kept.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"),
                                    F.lit(0).cast("bigint").alias("label_error")), books
    kept.where(F.size("vector") == dims).mapInArrow(
        _coded(books, dims), f"vec_id long, label {kind}, code string, error long").write.parquet(f"{scratch}/codes")
    codes = spark.read.parquet(f"{scratch}/codes")
    known = F.count("error") == F.count(F.lit(1))
    codes.groupBy("label").agg(F.when(known, F.try_sum("error")).alias("label_error")).write.parquet(f"{scratch}/labels")
    sums = spark.read.parquet(f"{scratch}/labels").withColumnRenamed("label", "of")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books
