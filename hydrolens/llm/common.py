"""Helpers shared by the operators: tokenizer with a word memo, files in the shared folder, sorted ranges."""
from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's word memo before it starts anew; bounds the memory of a Python worker.
MEMO = 600_000
#: Rows of the bounded sample behind sorted ranges, for each range.
SAMPLE_PER_RANGE = 60


def byte_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def by_size(texts: list[str | None], chars: int = 1 << 21) -> Iterator[list[str]]:
    """The texts (None as empty) in runs of about so many characters, to bound what is split into words at once."""
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(t or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


class Encoder:
    """Token ids of whole texts as flat little-endian bytes, by the tokenizers library.

    A byte-level BPE tokenizer splits a text before each single space, so the ids
    of a text are the ids of its space-led words in a row. Each distinct word goes
    through the library's model once, in the pre-tokens that the library makes of it,
    and is remembered. Texts in which white space meets
    white space around a space split differently and go through it whole.
    """

    _uneven = re.compile(r"\s (?:\s|$)|^ \s")
    #: Words of characters whose class is the same in every version of Unicode, and their split into pre-tokens.
    _settled = re.compile("[\n!-~¡-ɏ]+").fullmatch
    _split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall

    def __init__(self, path: str):
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        self.by_word = (spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                        and not pre.get("add_prefix_space"))
        #: Strings the tokenizer would cut out of a text before it splits it into words.
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        # a byte that isn't a printable Latin-1 character stands as one of the characters from 256 on, in order
        hidden = [b for b in range(256) if b not in {*range(33, 127), *range(161, 173), *range(174, 256)}]
        shown = {b: chr(256 + i) for i, b in enumerate(hidden)}
        #: What a byte-level model has for each character of a settled word.
        self.shown = {c: "".join(shown.get(b, chr(b)) for b in chr(c).encode()) for c in range(0x250)}
        self.memo: dict[str, bytes] = {}
        #: Words seen that are empty or begin or end in white space; only they can make a text split unevenly.
        self.edged: set[str] = set()
        self.marks = {m: ids.tobytes() for m, ids in zip(".,", self._library([".", ","]), strict=True)}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Ids of new words. One that only adds a point or comma to letters has those of the letters, then the mark's."""
        memo = self.memo
        marked = [w for w in words if w[-1:] in self.marks and w[:-1].isalpha()]
        words.difference_update(marked)
        words.update(b for w in marked if (b := w[:-1]) not in memo)
        odd = []
        tokenize, code = self.tokenizer.model.tokenize, self.code
        for w in words:
            if w.isalpha() and w.isascii():
                memo[w] = array(code, [t.id for t in tokenize("Ġ" + w)]).tobytes()
            elif parts := self._parts(w):
                memo[w] = array(code, [t.id for p in parts for t in tokenize(p)]).tobytes()
            else:
                odd.append(w)
        for w, ids in zip(odd, self._library([" " + w for w in odd]), strict=True):
            memo[w] = ids.tobytes()
        memo.update((w, memo[w[:-1]] + self.marks[w[-1]]) for w in marked)

    def _parts(self, word: str) -> list[str] | None:
        """The pre-tokens of a space-led word, as the library's model takes them; None if only the library can tell."""
        if not self._settled(word):
            return None
        if word.isalpha():
            return ["Ġ" + word.translate(self.shown)]
        return [p.translate(self.shown) for p in self._split(" " + word)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Flat ids of each text; None counts as empty. Ids have ``self.dtype``."""
        return [ids for part in by_size(texts) for ids in self._encode(part)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") if self.by_word and not any(s in t for s in self.special) else None for t in texts]
        words: set[str] = set()
        for s in split:
            if s:
                words.update(s[1:])
        if len(self.memo) > MEMO:  # what this batch needs stays
            self.memo = {w: self.memo[w] for w in words if w in self.memo}
            self.edged.intersection_update(words)
        new = words.difference(self.memo)
        self.edged.update(w for w in new if w.strip() != w or not w)
        if not self.edged.isdisjoint(words):
            split = [None if s and self._uneven.search(t) else s for t, s in zip(texts, split, strict=True)]
        self._learn(new)
        get = self.memo.__getitem__
        heads = self._library([s[0] if s else t for t, s in zip(texts, split, strict=True)])
        return [ids.tobytes() + (b"".join(map(get, s[1:])) if s else b"") for ids, s in zip(heads, split, strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def filesystem(uri: str):
    """Arrow file system and path of a folder of the shared store."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def publish(fs, made: str, final: str) -> None:
    """Rename a finished file; where an earlier attempt's equal file can't be replaced, that one stays."""
    try:
        fs.move(made, final)
    except OSError:
        if not fs.get_file_info(final).is_file:
            raise
        fs.delete_file(made)


def parts_for(df: DataFrame, rows: int, per_part: int) -> int:
    """Partitions for so many rows: at least the session's shuffle partitions, more if they'd be too large."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def range_splits(df: DataFrame, key: str, n: int, weight: str | None = None) -> list[float]:
    """At most ``n - 1`` split points of a long column, from a sample of about 60 rows for each range.

    The ranges hold like numbers of rows or, with ``weight``, like sums of that column.
    """
    rows = df.select(F.col(key).cast("double").alias("k"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("w"))
    part = min(1.0, SAMPLE_PER_RANGE * n / max(rows.count(), 1))
    found = sorted((r.k, r.w) for r in (rows if part == 1 else rows.sample(part, 17)).collect())
    if not found:
        return []
    sums = np.cumsum([w for _, w in found])
    at = np.searchsorted(sums, sums[-1] * np.arange(1, n) / n)
    return sorted({found[i][0] for i in at})


def with_range(df: DataFrame, key: str, splits: list[float], out: str) -> DataFrame:
    """``df`` with the number of the range, found by binary search, that ``key`` lies in."""
    if not splits:
        return df.withColumn(out, F.lit(0))
    cut = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="_key", outputCol="_range")
    return (cut.transform(df.withColumn("_key", F.col(key).cast("double")))
            .withColumn(out, F.col("_range").cast("int")).drop("_key", "_range"))


def not_null_key(column: str | Column) -> Column:
    """Rows without a number sort before all others."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("bigint"), F.lit(-(1 << 63)))


def rows_of(batches: Iterator, *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)
