"""Fill-in-middle transformation: texts cut into prefix, middle and suffix, with the middle moved to the end.

A unit is a word with the white space before it, or white space at the end of a
text. One match of ``(unit)*`` over the whole text, by the regex library, keeps the
end of every repetition: their number is the number of units, and the two cuts are
ends of repetitions picked by hashes of the document id. Quantifiers are possessive,
so the match never goes back and takes time and memory in proportion to the units
(about 150 bytes each while one text is matched).

Forms: ``psm`` is prefix, suffix, middle; ``spm`` suffix, prefix, middle, each part led
by its mark; ``plain`` is the text itself, also wherever it holds a mark, so that
``restore`` gets every text back exactly.

Defined results: a NULL or empty text is plain with 0 units and gives an empty output;
a NULL document id draws as an empty one; repeated rows come out alike; an empty table
gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens.llm.common import by_size

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 documents, so many are transformed, and of 100 of those so many into ``spm``.
RATE, SPM_RATE = 50, 80
#: Characters of texts whose outputs leave a worker at once.
CHARS = 1 << 22
UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers below 2^32 that seed and document id alone decide."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def cut(text: str, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """Units, form, code points of prefix and middle (None if plain), and the output of one text."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, doc_id: str = "doc_id",
              text: str = "text") -> DataFrame:
    """``doc_id``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at = b.column("doc_id"), 0
            for part in by_size(b.column("text").to_pylist(), CHARS):
                own = ids.slice(at, len(part))
                at += len(part)
                cols = zip(*(cut(t, i, seed, rate, spm_rate) for t, i in zip(part, own.to_pylist(), strict=True)), strict=True)
                n, form, prefix, middle, output = map(list, cols)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                     pa.array(output, pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, OUT)


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that an output of a form stands for.

    No part holds a mark and no two marks overlap, so each mark is found once.
    """
    o = F.col(output) if isinstance(output, str) else output
    f = F.col(form) if isinstance(form, str) else form
    led = F.substring(o, len(PREFIX) + 1, 2147483647)
    after = lambda mark: F.substring_index(o, mark, -1)
    psm = F.concat(F.substring_index(led, SUFFIX, 1), after(MIDDLE), F.substring_index(after(SUFFIX), MIDDLE, 1))
    spm = F.concat(F.substring_index(after(PREFIX), MIDDLE, 1), after(MIDDLE), F.substring_index(led, PREFIX, 1))
    return F.when(f == "psm", psm).when(f == "spm", spm).otherwise(o)
