"""Token files and packing: exact round trips against the tokenizers library."""
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hydrolens.llm import packing, token_files
from hydrolens.llm.common import Encoder, byte_bpe_path

WORDS = "the water meter reads twelve litres and more, every hour of the day. Größe élan señor 42 ½ don't".split()


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, 400))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i * 3) for i, t in enumerate(texts(60))]
    rows += [(None, "no id", 1), (100, None, 2), (101, "", 3), (102, "x" * 30_000 + " y" * 30_000, 4)]
    rows += [(103, "twice", 5), (103, "twice", 5), (104, "one id", 6), (104, "another text", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(5)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(byte_bpe_path())


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_library_on_any_white_space(library):
    rng = random.Random(3)
    odd = ["", " ", "a  b", " a", "a ", "x\n \ny", "don't 've", "\x85 a b", "<|endoftext|> a", "　 a", "a\x1c b"]
    odd += ["".join(rng.choice(" \n\tab'.,9é s\r") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    enc = Encoder(byte_bpe_path())
    for _ in range(2):  # the second time from the memo
        found = enc.encode(odd)
        assert [np.frombuffer(f, enc.dtype).tolist() for f in found] == [library.encode(t, add_special_tokens=False).ids for t in odd]


def test_memo_overflow_changes_nothing(library, monkeypatch):
    monkeypatch.setattr("hydrolens.llm.common.MEMO", 5)
    enc = Encoder(byte_bpe_path())
    for t in ["a b c d e f g", "h i  j", "a b x\n \ny z", "k l m n o", "a b x\n \ny z"]:
        assert np.frombuffer(enc.encode([t])[0], enc.dtype).tolist() == library.encode(t, add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs, library, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    shards = token_files.write_tokens(docs, folder, byte_bpe_path()).collect()
    rows = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    key = lambda i: -1 if i is None else i
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in docs.collect()), key=key)
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens * 4) == (at, len(r.ids))
        at += r.n_tokens
    assert sum(s.n_tokens for s in shards) == at
    want = sorted((key(r.doc_id), ids_of(library, r.text)) for r in docs.collect())
    assert sorted((key(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want


def test_token_files_are_flat_and_mapped(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    shards = token_files.write_tokens(docs, folder, byte_bpe_path()).collect()
    tokens, offsets, ids, known = token_files.read_shard(folder, shards[0].shard)
    assert isinstance(tokens, np.memmap) and tokens.dtype == "<u2" and offsets.dtype == "<u8"
    assert (tmp_path / f"tokens/tokens-{shards[0].shard:06d}.bin").stat().st_size == 2 * shards[0].n_tokens
    assert len(ids) == len(known) == shards[0].n_docs and tokens[int(offsets[1]) - 1] == 0


def test_cut_off_shard_is_refused(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    shard = token_files.write_tokens(docs, folder, byte_bpe_path()).collect()[0].shard
    path = tmp_path / f"tokens/tokens-{shard:06d}.bin"
    path.write_bytes(path.read_bytes()[:-2])
    with pytest.raises(ValueError, match="holds"):
        token_files.read_shard(folder, shard)


def test_empty_table(spark, docs, tmp_path):
    none = docs.limit(0)
    token_files.write_tokens(none, f"file://{tmp_path}/tokens", byte_bpe_path())
    assert token_files.read_tokens(spark, f"file://{tmp_path}/tokens").count() == 0
    assert packing.pack(none, byte_bpe_path(), f"file://{tmp_path}/packed").count() == 0


@pytest.mark.parametrize("length", [1024, 64])
def test_packing_covers_every_id_once(docs, library, tmp_path, length):
    rows = packing.pack(docs, byte_bpe_path(), f"file://{tmp_path}/p", length=length).collect()
    taken = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = 0
    for sequence, offset, n in taken:  # gapless, and only the last sequence is short
        assert (sequence * length + offset, n) == (at, n) and offset + n <= length
        at += n
    pieces = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        assert len(r.ids) == 4 * r.length
        pieces.setdefault(r.doc_id, []).append(r)
    by_id = {}
    for r in docs.collect():
        by_id.setdefault(r.doc_id, []).append(ids_of(library, r.text))
    for doc, want in by_id.items():
        found = sorted(i for r in pieces[doc] for i in np.frombuffer(r.ids, "<u4").tolist())
        assert found == sorted(i for w in want for i in w)
        if len(want) == 1:
            whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces[doc]])
            assert whole.tolist() == want[0] and {r.doc_tokens for r in pieces[doc]} == {len(want[0])}
            assert [r.start for r in pieces[doc]] == np.cumsum([0, *[r.length for r in pieces[doc]]])[:-1].tolist()


def test_query_digest_is_of_little_endian_32_bit_ids(spark):
    ids = np.array([1, 50256, 0], "<u4").tobytes()
    assert spark.range(1).select(F.crc32(F.lit(bytearray(ids)))).first()[0] == zlib.crc32(ids)


def test_hilbert_curve_visits_neighbouring_cells():
    for axes, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        cells = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(side)] * axes, indexing="ij")], axis=1)
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(side ** axes))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_on_the_curve_are_alike():
    rng = np.random.RandomState(0)
    topics = [rng.randint(0, 50_000, 40) for _ in range(8)]
    docs = [rng.choice(topics[i % 8], 200) for i in range(400)]
    v = np.array([packing.hashed_vector(d) for d in docs])
    order = np.argsort(packing.curve_keys(v))
    like = lambda o: float((v[o[1:]] * v[o[:-1]]).sum(axis=1).mean())
    assert like(order) > like(np.arange(400)) + 0.2
