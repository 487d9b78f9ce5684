"""Token counts of whole texts by a two-tier lookup of pre-token lengths, with no shuffle of pre-tokens.

A word-level BPE tokenizer normalises a text, splits it into pre-tokens and encodes
each by itself, so a text's tokens are the sum of its pre-tokens' lengths. The first
tier is a compact table of frequent pre-tokens, counted on a bounded sample and
broadcast (at most ``FREQUENT`` words of at most ``LONGEST`` characters). What it
misses goes once through the library in each worker and stays in the worker's cache,
the second tier. Neither tier changes a count, only its cost.

Texts are split here as the library splits them: those of characters that
normalisation leaves alone but for case are lower-cased directly, others pass the
library's normaliser first. Texts with a special token's string, or with characters
whose class depends on the version of Unicode, go whole through the library, and so
do all texts of a tokenizer of another make.

Defined results: a NULL or empty text has 0 tokens and 0 bytes; a NULL document id
comes back NULL; repeated rows are counted each; an empty table gives an empty
result; other columns are ignored.
"""
from __future__ import annotations

import json
import os
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolens.llm.common import by_size

#: Tokens above which a document counts as over the limit.
LIMIT = 2048
#: Words of the broadcast table and their most characters: it holds 4 MB of UTF-8 text at the very most.
FREQUENT, LONGEST = 40_000, 25
#: The bounded sample behind the table: share of rows, documents, characters of a document.
SAMPLE_SHARE, SAMPLE_DOCS, SAMPLE_CHARS = 0.05, 4_000, 20_000
#: Words of a worker's cache before it starts anew; longer words are not kept.
CACHE, KEPT = 400_000, 64
#: Characters of texts that are split at once.
CHARS = 1 << 20


def word_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Lengths(dict):
    """The frequent words' lengths; a word that isn't among them is looked up in the worker's cache."""

    def __init__(self, frequent: dict[str, int]):
        super().__init__(frequent)
        self.cache: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        return self.cache[word]


@cache
def _unsettled() -> regex.Pattern:
    """Matches all code points whose being a letter, number or space depends on the version of Unicode.

    Code points that are none of these in this version and were none in version 3.2 are settled.
    """
    old, spans = unicodedata.ucd_3_2_0, []
    kind = lambda c: c[0] if c[0] in "LN" or c == "Zs" else ""
    for i in range(0x110000):
        now = unicodedata.category(chr(i))
        if now in ("Cn", "Cs") or kind(now) != kind(old.category(chr(i))):
            if spans and spans[-1][1] == i - 1:
                spans[-1][1] = i
            else:
                spans.append([i, i])
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


class Counting:
    """Numbers of tokens of whole texts, as the tokenizers library gives them without added special tokens."""

    #: Characters that composition leaves alone, whatever stands beside them.
    _simple = regex.compile("[^\\x00-˿‐-‧‰-⁞]")

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        pattern = self._pattern(spec)
        self.split = pattern and regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        # pre-tokens come normalised and without special tokens
        self.words = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": []}))
        self.lengths = Lengths(frequent or {})

    @staticmethod
    def _pattern(spec: dict) -> str | None:
        """The pattern of the pre-tokens, where the tokenizer composes, lower-cases and splits by a pattern alone."""
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if (steps != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in split] != ["Split", "ByteLevel"]
                or spec["normalizer"]["normalizers"][1]["pattern"] != {"Regex": r"\s+"}
                or split[0]["behavior"] != "Removed" or not split[0]["invert"] or "Regex" not in split[0]["pattern"]
                or split[1]["add_prefix_space"] or split[1]["use_regex"] or spec["post_processor"]):
            return None
        return split[0]["pattern"]["Regex"]

    def pre_tokens(self, text: str) -> list[str] | None:
        """A text's pre-tokens; None if only the library can tell."""
        if not self.split or any(s in text for s in self.special):
            return None
        if not self._simple.search(text):
            return self.split.findall(text.lower())
        if _unsettled().search(text):
            return None
        return self.split.findall(self.whole.normalizer.normalize_str(text))

    def _learn(self, words: list[str]) -> dict[str, int]:
        return dict(zip(words, map(len, self.words.encode_batch_fast(words, add_special_tokens=False)), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        return [n for part in by_size(texts, CHARS) for n in self._count(part)]

    def _count(self, texts: list[str]) -> list[int]:
        split = [self.pre_tokens(t) for t in texts]
        if len(self.lengths.cache) > CACHE:
            self.lengths.cache.clear()
        cache = self.lengths.cache
        new = set().union(*filter(None, split)).difference(self.lengths, cache)
        for i in range(0, len(found := list(new)), 10_000):
            cache.update(self._learn(found[i:i + 10_000]))
        get = self.lengths.__getitem__
        out = [None if s is None else sum(map(get, s)) for s in split]
        for w in [w for w in new if len(w) > KEPT]:
            del cache[w]
        odd = [t for t, s in zip(texts, split, strict=True) if s is None]
        left = iter(self.whole.encode_batch_fast(odd, add_special_tokens=False))
        return [len(next(left)) if n is None else n for n in out]


def frequent_words(docs: DataFrame, path: str, text: str = "text") -> dict[str, int]:
    """Lengths of the commonest pre-tokens of a bounded sample; reads only as many partitions as that takes."""
    short = docs.select(F.col(text).cast("string").alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    rows = short.sample(SAMPLE_SHARE, 12).limit(SAMPLE_DOCS).collect()
    counting, seen = Counting(path), Counter()
    for r in rows:
        seen.update(w for w in counting.pre_tokens(r.text) or () if len(w) <= LONGEST)
    words = sorted(sorted(seen), key=lambda w: -seen[w])[:FREQUENT]
    return counting._learn(words) if words else {}  # noqa: SLF001


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every whole text."""
    words = frequent_words(docs, path, text)
    # one string and one array in place of a dictionary of objects; no pre-token holds white space
    table = docs.sparkSession.sparkContext.broadcast(("\n".join(words), list(words.values())))
    kept: list[Counting] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:  # once in a worker
            names, lengths = table.value
            kept.append(Counting(path, dict(zip(names.split("\n"), lengths, strict=True)) if lengths else None))
        for b in batches:
            texts = b.column("text")
            n = kept[0].count(texts.to_pylist())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
