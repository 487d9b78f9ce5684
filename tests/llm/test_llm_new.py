"""Fill-in-middle, token counts and vector codes against brute force and the tokenizers library."""
import hashlib
import math
import random
import re
import sys
import unicodedata
from fractions import Fraction

import numpy as np
import pytest
from hydrolens.llm import fill_middle, token_counts, vector_codes
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# --- fill in middle -----------------------------------------------------------------------------
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle_by_steps(text, doc_id):
    units = UNIT.findall(text)
    n, h = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \n\t\x0b\x0c\rab<>PSM\xa0é😀") for _ in range(rng.randint(0, 30))) for _ in range(600)]
    return [*texts, None, "", " ", "\n\n", "word", "a<P>b", "x <S", "<M", "lang " * 40_000 + "  "]


def test_fill_middle_equals_steps_and_restores(spark, odd_texts):
    rows = [(i, t, "clash", 1.0) for i, t in enumerate(odd_texts)] + [(None, "no id here", "x", 0.0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output double").repartition(3)
    out = fill_middle.transform(docs).withColumn("text", fill_middle.restored()).collect()
    want = sorted((str(i), *map(str, middle_by_steps(t or "", i)), t or "") for i, t, *_ in rows)
    assert sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.text) for r in out) == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_fill_middle_parameters_and_empty_table(spark):
    docs = spark.range(300).select(F.col("id").alias("key"), F.lit("one two three four five").alias("body"))
    every = fill_middle.transform(docs, seed=7, rate=100, spm_rate=0, doc_id="key", text="body")
    assert {r.form for r in every.collect()} == {"psm"}
    cuts = {(r.prefix_chars, r.middle_chars) for r in every.collect()}
    assert len(cuts) == 21  # all pairs of six places
    assert fill_middle.transform(docs.limit(0), doc_id="key", text="body").count() == 0


def test_one_match_keeps_every_repetition():
    ends = fill_middle.UNITS.fullmatch(" a  bc \n").ends(1)
    assert ends == [2, 6, 8]
    assert fill_middle.UNITS.fullmatch("").ends(1) == []


# --- token counts -------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.word_bpe_path())


def counts_of(library, texts):
    return [len(e.ids) for e in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_every_character_splits_as_in_the_library(library):
    counting = token_counts.Counting(token_counts.word_bpe_path())
    every = [chr(c) for c in [*range(0x10000), *range(0x10000, 0x110000, 23)] if unicodedata.category(chr(c)) != "Cs"]
    texts = ["a" + c + "1" + c + "!" + c + "b" for c in every]
    split = [i for i, t in enumerate(texts) if counting.pre_tokens(t) is not None]
    assert len(split) > 50_000  # all settled characters; no string here goes whole through the library without need
    found, want = counting.count([texts[i] for i in split]), counts_of(library, [texts[i] for i in split])
    assert [(texts[split[i]], a, b) for i, (a, b) in enumerate(zip(found, want, strict=True)) if a != b] == []


def test_counts_equal_library(library):
    rng = random.Random(8)
    pool = ["'s", "'S", "don't", "I'LL", " ", "\n", "\x85", "\x1c", "İ", "J̌", "é", "ΣΑΣ", "ß", "한", "하", "日本",
            "12", "½", "<|endoftext|>", "<|", "|>", "…", "—", "😀", "a" * 70, "͸", "\U0001f9ff", "᠎", "​", "ﬁ", "!!", "''"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(4000)] + [None, "", "x" * 20_000, "ab " * 50_000]
    want = counts_of(library, texts)
    counting = token_counts.Counting(token_counts.word_bpe_path(), {"don": 1})
    assert counting.count(texts) == want
    assert counting.count(texts) == want  # from the cache
    assert all(len(w) <= token_counts.KEPT for w in counting.lengths.cache)


def test_cache_overflow_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 3)
    monkeypatch.setattr(token_counts, "CHARS", 10)
    texts = ["meter reading litres", "leak in the house", "meter in the house", "ünï cödé"] * 5
    assert token_counts.Counting(token_counts.word_bpe_path()).count(texts) == counts_of(library, texts)


def test_token_counts_of_a_table(spark, library):
    texts = ["the water meter", None, "", "<|endoftext|> and <|startoftext|>", "Größe " * 3000, "日本語 text", "the water meter"]
    rows = [(i, t, -1) for i, t in enumerate(texts)] + [(None, "no id", 5), (0, "twice", 5), (0, "twice", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    out = token_counts.token_counts(docs, token_counts.word_bpe_path(), limit=100).collect()
    want = counts_of(library, [t for _, t, _ in rows])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out) == sorted(
        (str(i), len((t or "").encode()), n, n > 100) for (i, t, _), n in zip(rows, want, strict=True))
    assert token_counts.token_counts(docs.limit(0), token_counts.word_bpe_path()).count() == 0


def test_another_tokenizer_goes_whole_through_the_library(spark):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two  spaces", "a\nb", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert [found[i] for i in range(3)] == counts_of(Tokenizer.from_file(path), texts)


def test_frequent_words_are_bounded_and_no_pre_token_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "FREQUENT", 5)
    monkeypatch.setattr(token_counts, "SAMPLE_SHARE", 1.0)
    docs = spark.createDataFrame([(i, "the the the meter a " + "y" * 40) for i in range(50)], "doc_id long, text string")
    words = token_counts.frequent_words(docs, token_counts.word_bpe_path())
    assert list(words) == ["the", "a", "meter"] and set(words.values()) == {1}
    counted = token_counts.token_counts(docs, token_counts.word_bpe_path())
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


# --- vector codes -------------------------------------------------------------------------------
def codes_by_steps(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label) to (vec_id, code, error, label_error) and the codebooks, entry by entry."""
    ok = lambda v: v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)
    kept = sorted((r for r in rows if ok(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return [], []
    step = len(kept[0][1]) // parts
    ints = [[math.floor(256 * Fraction(x)) for x in r[1]] for r in kept]
    cut = [[v[p * step:(p + 1) * step] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, w: min((far(w, e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        moved = []
        for p in range(parts):
            own = [near(p, c[p])[1] for c in cut]
            book = []
            for i, e in enumerate(books[p]):
                members = [c[p] for c, k in zip(cut, own, strict=True) if k == i]
                book.append([sum(col) // len(members) for col in zip(*members, strict=True)] if members else e)
            moved.append(book)
        books = moved
    out = [(r[0], [near(p, c[p]) for p in range(parts)], r[2]) for r, c in zip(kept, cut, strict=True)]
    errors = [sum(d for d, _ in n) for _, n, _ in out]
    by_label = {}
    for (_, _, label), e in zip(out, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    big = lambda v: v if v < 1 << 63 else None
    alone = {o[2] for o, e in zip(out, errors, strict=True) if big(e) is None}
    return [(i, "".join(f"{k:02x}" for _, k in n), big(e), None if label in alone else big(by_label[label]))
            for (i, n, label), e in zip(out, errors, strict=True)], books


VECTORS = "vec_id long, embedding array<double>, label int, code string, vector int"


def vectors(n, dims, seed=2, scale=0.2):
    rng = np.random.RandomState(seed)
    return [(i, rng.normal(0, scale, dims).tolist(), int(rng.randint(3))) for i in range(n)]


CASES = {
    "plain": vectors(300, 32),
    "few": vectors(5, 16),
    "coarse, with many common prefixes and ties": [(i, [round(x * 4) / 128 for x in v], j) for i, v, j in vectors(400, 64)],
    "repeated rows, NULL ids and labels": [*vectors(90, 32), *vectors(90, 32), *[(None, v, None) for _, v, _ in vectors(20, 32, 4)],
                                           *[(500, [0.5] * 32, None)] * 100],
    "dropped": [*vectors(100, 32), (1, None, 1), (2, [], 1), (3, [1.0] * 31 + [None], 1), (4, [math.nan] * 32, 1),
                (5, [math.inf] + [0.0] * 31, 1), (6, [0.1] * 48, 2), (7, [0.1] * 33, 2)],
    "past 64 bits": [*vectors(70, 16), (200, [1e30] * 16, 1), (201, [-1e300] * 16, 2), (202, [2.0 ** 60] + [0.0] * 15, 0)],
    "none": [(1, None, 1), (2, [math.inf] * 16, 1)],
}


@pytest.mark.parametrize("name", CASES)
def test_codes_equal_steps(spark, tmp_path, name):
    rows = CASES[name]
    table = spark.createDataFrame([(*r, "clash", 7) for r in rows], VECTORS).repartition(4)
    out, books = vector_codes.compress(table, f"file://{tmp_path}/codes")
    want, want_books = codes_by_steps(rows)
    found = sorted((str(r.vec_id), r.code, str(r.error), str(r.label_error)) for r in out.collect())
    assert found == sorted((str(i), c, str(e), str(le)) for i, c, e, le in want)
    assert books == want_books or not want


def test_empty_table_of_vectors(spark, tmp_path):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS), f"file://{tmp_path}/c")[0].count() == 0


@pytest.mark.parametrize("block", [1, 3, 50, 10_000])
@pytest.mark.parametrize("kind", [np.int64, object])
def test_trie_equals_all_distances(block, kind):
    rng = np.random.RandomState(block)
    for dims, high in ((1, 9), (3, 4), (5, 300)):
        parts, entries = rng.randint(-high, high, (700, dims)).astype(kind), rng.randint(-high, high, (20, dims)).astype(kind)
        leaves, place, weight = vector_codes.distinct(parts)
        assert (leaves[place] == parts).all() and weight.sum() == 700
        assert [tuple(r) for r in leaves] == sorted({tuple(r) for r in parts})
        codes, errors = vector_codes.nearest(leaves, entries, block)
        far = ((leaves[:, None] - entries[None]) ** 2).sum(axis=2)
        assert codes.tolist() == far.argmin(axis=1).tolist() and errors.tolist() == far.min(axis=1).tolist()


def test_common_prefixes_are_computed_once(monkeypatch):
    """The distances of a level are taken once for each distinct prefix, not for each part."""
    grid = np.array([(a, b, c) for a in range(4) for b in range(4) for c in range(64)], np.int64)
    taken = []
    real = np.searchsorted
    monkeypatch.setattr(vector_codes.np, "searchsorted", lambda first, start, side: taken.append(len(start)) or real(first, start, side))
    vector_codes.nearest(grid, np.zeros((2, 3), np.int64))
    assert taken == [4, 16, 1024]


def test_whole_numbers_are_floors():
    x = [0.0, -0.0, 1 / 256, -1 / 512, 0.999, -3.7, sys.float_info.min, -sys.float_info.min]
    assert vector_codes.whole(np.array([x])).tolist() == [[math.floor(256 * Fraction(v)) for v in x]]
    big = [1e300, -1e300, 2.0 ** 70, 0.3]
    assert vector_codes.whole(np.array([big])).tolist() == [[math.floor(256 * Fraction(v)) for v in big]]
