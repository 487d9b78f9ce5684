"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Documents are range-sorted by id; each task encodes its range and writes one
shard: ``tokens-N.bin`` (ids in a row, little-endian, 16 bits wide where the
vocabulary allows) and ``index-N.bin`` (document offsets and ids). The shards'
first positions in the whole corpus are prefix sums over the shards' sizes, kept
in ``manifest``. Readers map the files into memory and never parse them.

A task writes under a name of its own attempt and renames when done, and the same
rows give the same bytes, so a lost or repeated task leaves one whole shard.

Defined results: a NULL or empty text is the end id alone; a NULL document id
sorts first and comes back NULL; rows of one id follow each other in the order of
a hash of their texts, repeated rows stay; an empty table gives no shards; other
columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydrolens.llm.common import encoder, filesystem, not_null_key, parts_for, publish, rows_of

MAGIC = b"TOKIDX01"
#: Documents of a shard, about.
SHARD_DOCS = 50_000
#: Bytes of ids that a reader hands on at once.
READ_BYTES = 8 << 20
MANIFEST = "shard int, n_docs long, n_tokens long, id_bytes int"


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), None
        lengths: list[int] = []
        ids: list[int | None] = []
        fs, root = filesystem(folder)
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        sink, made = None, f"{root}/.{shard}-{attempt}"
        for b in batches:
            if sink is None:
                end = np.array([end_id], enc.dtype).tobytes()
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(made + ".tokens")
            for flat in enc.encode(b.column("text").to_pylist()):
                sink.write(flat + end)
                lengths.append(len(flat) // enc.dtype.itemsize + 1)
            ids += b.column("doc_id").to_pylist()
        if sink is None:
            return
        sink.close()
        offsets = np.zeros(len(ids) + 1, "<u8")
        np.cumsum(lengths, out=offsets[1:])
        with fs.open_output_stream(made + ".index") as f:
            f.write(MAGIC + np.array([len(ids), enc.dtype.itemsize], "<u8").tobytes() + offsets.tobytes())
            f.write(np.array([i or 0 for i in ids], "<i8").tobytes())
            f.write(np.array([i is not None for i in ids], "u1").tobytes())
        publish(fs, made + ".tokens", f"{root}/tokens-{shard:06d}.bin")
        publish(fs, made + ".index", f"{root}/index-{shard:06d}.bin")
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()),
            "n_tokens": pa.array([int(offsets[-1])], pa.int64()), "id_bytes": pa.array([enc.dtype.itemsize], pa.int32())})
    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Write all texts in ascending document id; the manifest with each shard's first position (``base``)."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"),
                       not_null_key(doc_id).alias("k"), F.xxhash64(text).alias("h"))
    n = parts_for(docs, docs.count(), SHARD_DOCS)
    placed = rows.repartitionByRange(n, "k", "h").sortWithinPartitions("k", "h").select("doc_id", "text")
    placed.mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(docs.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row a shard; ``base``: ids of all shards before it, a prefix sum over the shards."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("bigint"))


def _mapped(fs, path: str, dtype: str | np.dtype, offset: int = 0, count: int | None = None) -> np.ndarray:
    """A file's numbers, memory-mapped where the store is a file system."""
    from pyarrow.fs import LocalFileSystem
    if isinstance(fs, LocalFileSystem):
        return np.memmap(path, dtype, "r", offset, None if count is None else (count,))
    with fs.open_input_file(path) as f:
        size = f.size() - offset if count is None else count * np.dtype(dtype).itemsize
        return np.frombuffer(f.read_at(size, offset), dtype)


def read_shard(folder: str, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, document offsets (one more than documents), document ids and which of them are not NULL."""
    fs, root = filesystem(folder)
    path = f"{root}/index-{shard:06d}.bin"
    head = _mapped(fs, path, "u1", 0, 24).tobytes()
    if head[:8] != MAGIC:
        raise ValueError(f"{path} is no index file")
    n, width = (int(x) for x in np.frombuffer(head[8:], "<u8"))
    offsets = _mapped(fs, path, "<u8", 24, n + 1)
    ids = _mapped(fs, path, "<i8", 24 + 8 * (n + 1), n)
    known = _mapped(fs, path, "u1", 24 + 8 * (n + 1) + 8 * n, n)
    tokens = _mapped(fs, f"{root}/tokens-{shard:06d}.bin", f"<u{width}")
    if len(tokens) != offsets[-1]:
        raise ValueError(f"shard {shard} of {folder} holds {len(tokens)} ids, not {offsets[-1]}")
    return tokens, offsets, ids, known


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (32 bits each)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, base in rows_of(batches, "shard", "base"):
            tokens, offsets, ids, known = read_shard(folder, shard)
            step = np.dtype(tokens.dtype).itemsize
            first = 0
            while first < len(ids):
                last = int(np.searchsorted(offsets, int(offsets[first]) + READ_BYTES // step, "right")) - 1
                last = min(max(last, first + 1), len(ids))
                at = offsets[first:last + 1].astype("i8")
                flat = tokens[at[0]:at[-1]].astype("<u4")
                cells = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), last - first, [None, pa.py_buffer((at - at[0]) * 4), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first:last], mask=known[first:last] == 0), pa.array(at[:-1] + base),
                     pa.array(np.diff(at)), cells.cast(pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])
                first = last
    shards = manifest(spark, folder).select("shard", "base")
    return shards.repartition(parts_for(shards, 0, 1), "shard").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids binary")
