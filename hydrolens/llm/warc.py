"""WARC archives of one Zstandard frame a record, with a shared dictionary.

An archive begins with a skippable frame that holds the dictionary (itself
compressed or not); the dictionary is trained on a bounded sample of payloads.
The reader streams an archive frame by frame, never more than one record in
memory, and checks version, header lines, declared lengths and digests; what does
not hold is reported in the record's ``error`` instead of ending the job.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with
the smallest page id is a response, the others are revisits that refer to it.

Defined results: a NULL or empty payload is a response without content; a NULL URL
gives a record without target; a NULL page id is written as ``null``, read back as
NULL, and never chosen to be referred to; rows of one page id are all responses
if that id is the one referred to; an empty table gives no archive and an empty
result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens.llm.common import filesystem, publish, rows_of

REVISIT_BYTES = 100
#: Bounds of the dictionary's sample: payloads expected, and bytes of each.
SAMPLE_PAGES = 400
SAMPLE_BYTES = 32 << 10
DICTIONARY_BYTES = 64 << 10
DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
MAGIC = struct.pack("<I", FRAME)
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
#: Size from which on a partition's next record begins another archive.
ARCHIVE_BYTES = 1 << 30
MANIFEST = "path string, n_records long, n_bytes long"
RECORD = ("archive string, at long, record_type string, record_id string, refers_to string, target_uri string, "
          "payload binary, payload_bytes long, payload_digest string, error string")
_REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def with_originals(pages: DataFrame, scratch: str, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload`` (bytes), its ``digest``, and ``original``: the page a revisit refers to.

    The digests found more than once are written to ``scratch`` first. A join with that table
    is a plain one: Spark broadcasts it while it is small, so that payloads stay where they
    are, and beyond that splits a digest that many pages share.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    copies = (rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest")
              .agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    copies.write.mode("overwrite").parquet(scratch)
    joined = rows.join(pages.sparkSession.read.parquet(scratch), "digest", "left")
    return joined.withColumn("original", F.when(~F.col("original").eqNullSafe(F.col("page_id")), F.col("original")))


def train(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary from about ``SAMPLE_PAGES`` payloads of at most ``SAMPLE_BYTES``; none from too few.

    Payloads are drawn by their hash, so tasks send only the drawn ones to the driver.
    """
    short = pages.select(F.col(html).alias("html")).where(F.octet_length("html").between(64, SAMPLE_BYTES))
    top = min((1 << 64) - 1, (SAMPLE_PAGES << 64) // max(short.count(), 1)) - (1 << 63)
    drawn = short.where(F.xxhash64("html") <= top).distinct()
    found = sorted(r.html.encode() for r in drawn.collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    """One WARC record; control characters in header values are percent-encoded."""
    lines = {"WARC-Type": kind, "WARC-Date": DATE, **headers, "Content-Length": str(len(block))}
    safe = lambda v: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", v)
    head = "".join(f"{k}: {v if k.startswith('Content-') else safe(v)}\r\n" for k, v in lines.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Record-ID": urn(page_id), "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{digest}",
               "Content-Type": "application/http; msgtype=response"}
    if original is None:
        return record("response", headers, http + payload)
    return record("revisit", headers | {"WARC-Refers-To": urn(original), "WARC-Profile": PROFILE}, http)


def _writer(folder: str, dictionary: bytes, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        given = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        press = zstandard.ZstdCompressor(write_checksum=True, **given)
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
        info = {"WARC-Record-ID": f"<urn:x-archive:{part}>", "Content-Type": "application/warc-fields"}
        rows, number = rows_of(batches, "page_id", "url", "payload", "digest", "original"), 0
        row = next(rows, None)
        while row is not None:
            name, n, size = f"pages-{part:06d}-{number:04d}.warc.zst", 0, 0
            made = f"{root}/.{name}-{attempt}"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(made, compression=None) as sink:
                if packed:
                    size += sink.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
                size += sink.write(press.compress(record("warcinfo", info, b"format: WARC File Format 1.1\r\n")))
                while row is not None and (not n or size < archive_bytes):
                    size += sink.write(press.compress(page_record(*row)))
                    n, row = n + 1, next(rows, None)
            publish(fs, made, f"{root}/{name}")
            number += 1
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n], "n_bytes": [size]})
    return write


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", html: str = "html",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives under ``folder``; the list of archives, also kept in ``manifest``.

    A partition begins another archive after ``archive_bytes``, as each archive is read by one task.
    """
    rows = with_originals(pages, f"{folder}/copies", page_id, html).select("page_id", "url", "payload", "digest", "original")
    made = rows.mapInArrow(_writer(folder, train(pages, html), archive_bytes), MANIFEST)
    made.write.mode("overwrite").parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def frames(stream) -> Iterator[tuple[int, bytes | None, str | None]]:
    """Place and content of each frame of an archive, or what is wrong with it.

    After a damaged frame the reader goes on at the next frame that opens as a WARC
    record; what lies between is one error. Other skippable frames than a leading
    dictionary are passed over.
    """
    held, at, opener, first = b"", 0, zstandard.ZstdDecompressor(), True

    def more(n: int) -> bool:
        nonlocal held
        while len(held) < n and (got := stream.read(max(CHUNK, n - len(held)))):
            held += got
        return len(held) >= n

    def seek() -> int:
        """Drop what is held up to the next readable frame; how much that was."""
        nonlocal held
        dropped, start = 0, 1
        while True:
            place = held.find(MAGIC, start)
            if place < 0:
                cut = max(len(held) - 3, 0)
                dropped, held, start = dropped + cut, held[cut:], 0 if cut else start
                if not more(len(held) + 1):
                    dropped, held = dropped + len(held), b""
                    return dropped
                continue
            more(place + CHUNK)
            try:
                opens = opener.decompressobj().decompress(held[place:place + CHUNK]).startswith(b"WARC/1.")
            except zstandard.ZstdError:
                opens = False
            if opens:
                held = held[place:]
                return dropped + place
            start = place + 1

    while more(1):
        if not more(8):
            yield at, None, "archive ends inside a frame"
            return
        magic, size = struct.unpack("<II", held[:8])
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if not more(8 + size):
                yield at, None, "archive ends inside a skippable frame"
                return
            body, held = held[8:8 + size], held[8 + size:]
            if first and magic == DICTIONARY_FRAME:
                try:
                    if body[:4] == struct.pack("<I", FRAME):
                        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
                except zstandard.ZstdError as e:
                    yield at, None, f"damaged dictionary: {e}"
                    return
            at, first = at + 8 + size, False
            continue
        first = False
        one, parts, fed, wrong = opener.decompressobj(), [], [], None
        try:
            while not one.eof and wrong is None:
                if not held and not more(1):
                    wrong = "archive ends inside a frame"
                else:
                    fed.append(held)
                    held = b""
                    parts.append(one.decompress(fed[-1]))
        except zstandard.ZstdError as e:
            wrong = f"damaged frame: {e}"
        yield at, None if wrong else b"".join(parts), wrong
        held = b"".join(fed) if wrong else one.unused_data
        at += seek() if wrong else sum(map(len, fed)) - len(held)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; ValueError says what does not hold."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC version line or no end of headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("a header line without a name")
        headers[name.decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if missing := [h for h in _REQUIRED if h not in headers]:
        raise ValueError(f"no {', '.join(missing)}")
    if not headers["Content-Length"].isdecimal():
        raise ValueError("Content-Length is no number")
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}, the frame holds {len(rest) - 4}")
    return headers, rest[:n]


def body(block: bytes) -> tuple[bytes, int]:
    """What follows an HTTP head, and the length that the head declares."""
    head, found, rest = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
    if not found or not head.startswith(b"HTTP/") or not m:
        raise ValueError("no HTTP head with a length")
    return rest, int(m[1])


def _row(archive: str, at: int, raw: bytes | None, error: str | None) -> tuple:
    headers: dict[str, str] = {}
    payload, n, digest = None, None, None
    try:
        if raw is None:
            raise ValueError(error)
        headers, block = parse(raw)
        digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None
        if headers["WARC-Type"] in ("response", "revisit"):
            payload, n = body(block)
        if headers["WARC-Type"] == "response":
            if len(payload) != n:
                raise ValueError(f"the HTTP head declares {n} bytes, {len(payload)} follow")
            if digest and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError("the payload's digest differs")
        elif headers["WARC-Type"] == "revisit":
            payload = None
            if "WARC-Refers-To" not in headers:
                raise ValueError("a revisit that refers to nothing")
    except ValueError as e:
        error = str(e)
    get = headers.get
    return (archive, at, get("WARC-Type"), get("WARC-Record-ID"), get("WARC-Refers-To"), get("WARC-Target-URI"), payload,
            n, digest, error)


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives in column ``path``, each archive streamed by one task."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in RECORD.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for (path,) in rows_of(batches, "path"):
            fs, file = filesystem(path)
            rows, size = [], 0
            with fs.open_input_stream(file, compression=None) as stream:
                for at, raw, error in frames(stream):
                    rows.append(_row(path, at, raw, error))
                    size += len(raw or b"")
                    if size > CHUNK * 8:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)
    paths = archives.select("path")
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(read, RECORD)


def page_ids(column: str) -> Column:
    """The page id that a record id of this writer names."""
    return F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"^<urn:x-page:(-?\d+)>$", 1).try_cast("bigint")
