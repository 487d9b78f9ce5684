"""SentencePiece BPE with seeded merge-dropout, and its lossless decoding.

Words (runs of spaces with the characters after them, between line ends) are
merged from single characters by an agenda of candidate merges, best score first.
Each candidate taken from the agenda is skipped if a hash keyed by seed, stream,
word, place and piece falls below the dropout rate. Characters outside the
vocabulary become byte pieces, and so does the model's own space mark where it
stands in a text, so that every segmentation decodes to its text exactly.

A word occurrence has a stream of its own, keyed by document id and place, so that
its merges drop out independently of all other occurrences (``variants`` above 0
limits the streams to so many). A worker remembers cuts as a tree: a node is a word
with the candidates skipped so far, and holds the candidates that follow and the cut
if none of them is skipped. The draws of an occurrence lead it down the tree.

Defined results: a NULL or empty text has no pieces and decodes to an empty text;
a NULL document id draws as id -1; repeated rows get equal pieces; an empty table
gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolens.llm.common import by_size

MARK = "▁"
#: Sets the mark in a text apart from the model's; no text can hold it.
APART = "\ud800"
DROPOUT = 0.1
SEED = 20
#: Streams that word occurrences draw from; 0: each has its own.
VARIANTS = 0
#: Nodes that a worker remembers before it starts anew.
MEMO = 250_000
#: Characters of texts that are split into words at once.
CHARS = 1 << 19
#: Ids that are decoded at once, unless one text has more.
DECODED = 1 << 17
#: Characters up to which words are cut many at once, so many in a block; longer ones are cut one by one.
SHORT = 48
BLOCK = 4_000
_MASK = (1 << 64) - 1


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class _Roots(dict):
    """Word to its root node; new words get the next numbers, long ones (not remembered) numbers below 0."""

    def __init__(self, next_node: int = 0):
        self.next, self.new, self.long = next_node, [], []

    def __missing__(self, word: str) -> int:
        if len(word) > SHORT:
            self.long.append(word)
            return -len(self.long)
        self[word] = node = self.next
        self.next += 1
        self.new.append(word)
        return node


class _Rows:
    """Numbers that grow at the end."""

    def __init__(self, dtype: type):
        self.held, self.n = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            grown = np.zeros(max(2 * len(self.held), self.n + len(values)), self.held.dtype)
            grown[:self.n] = self.held[:self.n]
            self.held = grown
        self.held[self.n:self.n + len(values)] = values
        self.n += len(values)


class _Tree:
    """Nodes: the draws that follow (ragged) and the cut if none of them is a skip (ragged), the word and its hash."""

    def __init__(self):
        self.draws, self.draw_at, self.draw_n = _Rows(np.uint64), _Rows(np.int64), _Rows(np.int64)
        self.ids, self.id_at, self.id_n = _Rows(np.uint32), _Rows(np.int64), _Rows(np.int64)
        self.hash, self.words = _Rows(np.uint64), []
        self.child: dict[int, int] = {}

    def add(self, words: list[str], hashes: np.ndarray, cuts: tuple) -> None:
        ids, id_n, draws, draw_n = cuts
        for rows, at, count, values, n in ((self.ids, self.id_at, self.id_n, ids, id_n),
                                           (self.draws, self.draw_at, self.draw_n, draws, draw_n)):
            at.add(rows.n + np.cumsum(n) - n)
            count.add(n)
            rows.add(values)
        self.hash.add(hashes)
        self.words += words


def ragged(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of so many values each from each start on."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Segmenter:
    """A SentencePiece BPE model whose merges drop out by a keyed hash."""

    def __init__(self, path: str, seed: int = SEED, dropout: float = DROPOUT, variants: int = VARIANTS):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.seed, self.variants = seed, variants
        self.bound = int(dropout * (1 << 64))
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        #: Merges in order of falling score.
        self.rank = {model.id_to_piece(i): r for r, i in enumerate(sorted(plain, key=lambda i: -model.get_score(i)))}
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.bytes = [b""] * n
        for piece, i in self.ids.items():
            self.bytes[i] = piece.replace(MARK, " ").encode()
        for value, i in self.byte_ids.items():
            self.bytes[i] = bytes([value])
        self.flat: tuple[np.ndarray, ...] | None = None
        if any(re.search(f"[^{MARK}]{MARK}|.\n|\n.", p) for p in self.ids):
            raise ValueError("pieces of this model cross words")
        self.words = re.compile(" *[^ \n]+|\n| +")
        self._tables(n)
        self._forget()

    def _forget(self) -> None:
        self.tree, self.roots = _Tree(), _Roots()

    def _tables(self, n: int) -> None:
        """Numbers for cutting many words at once: characters' ids, and pairs of ids with the id they merge to."""
        self.n = n
        self.char = np.arange(n, n + 0x110000, dtype=np.int64)  # ids past the vocabulary stand for its missing characters
        for piece, i in self.ids.items():
            if len(piece) == 1 and piece != MARK:
                self.char[ord(piece)] = i
        self.char[ord(" ")] = self.ids[MARK]
        rank_of = {self.ids[piece]: r for piece, r in self.rank.items()}
        self.id_of = np.array(sorted(self.ids.values(), key=rank_of.__getitem__), np.int64)
        # a hash table of pairs with open places: a pair is looked for from its own place on up to the first empty one
        pairs = [(self.ids[p[:k]] * n + self.ids[p[k:]], rank_of[i]) for p, i in self.ids.items()
                 for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        self.shift = np.uint64(64 - (4 * len(pairs)).bit_length())
        self.pairs = np.full(1 << 64 - int(self.shift), -1, np.int64)
        self.pair_rank = np.full(len(self.pairs), len(self.id_of), np.int32)
        for (code, rank), at in zip(pairs, self._place(np.array([c for c, _ in pairs], np.int64)).tolist(), strict=True):
            while self.pairs[at] >= 0:
                at = (at + 1) % len(self.pairs)
            self.pairs[at], self.pair_rank[at] = code, rank

    def _place(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def key(self, word: str, stream: int) -> int:
        return self._keys(np.array([self._hash(word)], np.uint64), np.array([stream & _MASK], np.uint64)).tolist()[0]

    def _hash(self, word: str) -> int:
        return xxhash.xxh64_intdigest(word, self.seed & _MASK)

    @staticmethod
    def _keys(hashes: np.ndarray, streams: np.ndarray) -> np.ndarray:
        at = hashes ^ (streams + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        at = (at ^ at >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        at = (at ^ at >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return at ^ at >> np.uint64(31)

    def _skips(self, draw: np.ndarray) -> np.ndarray:
        draw = (draw ^ draw >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return draw ^ draw >> np.uint64(32) < np.uint64(min(self.bound, _MASK))

    def skipped(self, key: int, rank: int, place: int) -> bool:
        draw = (key ^ (rank * 0x9E3779B97F4A7C15 + place * 0xC2B2AE3D27D4EB4F)) & _MASK
        draw = (draw ^ draw >> 29) * 0xBF58476D1CE4E5B9 & _MASK
        return draw ^ draw >> 32 < self.bound

    def cut(self, word: str, stream: int) -> list[int]:
        """Ids of one word under one stream of skipped merges."""
        key = self.key(word, stream)
        # spaces take the model's mark; a mark in the text stays apart from it and is never merged
        symbols = [APART + c if c == MARK else c for c in word] if MARK in word else list(word)
        symbols = [MARK if c == " " else c for c in symbols] if word[0] == " " else symbols
        pieces = self._merge(symbols, key)
        out: list[int] = []
        for s in pieces:
            i = self.ids.get(s)
            if i is None:
                out += [self.byte_ids[b] for b in s.removeprefix(APART).encode()]
            else:
                out.append(i)
        return out

    def _merge(self, symbols: list[str | None], key: int) -> list[str]:
        """The agenda of one word as a heap."""
        end = len(symbols)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        rank = self.rank
        agenda = [(rank[a + b], i, a + b) for i, (a, b) in enumerate(pairwise(symbols)) if a + b in rank]
        heapq.heapify(agenda)
        while agenda:
            r, i, merged = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] is None or j == end or symbols[i] + symbols[j] != merged or self.skipped(key, r, i):
                continue
            symbols[i], symbols[j] = merged, None
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (new := merged + symbols[k]) in rank:
                    heapq.heappush(agenda, (rank[new], i, new))
            h = before[i]
            if h >= 0 and (new := symbols[h] + merged) in rank:
                heapq.heappush(agenda, (rank[new], h, new))
        return [s for s in symbols if s is not None]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids; the number of pieces where there is none."""
        out = np.full(len(left), len(self.id_of), np.int32)
        rows = np.flatnonzero((left < self.n) & (right < self.n) & (right >= 0))
        code = left[rows].astype(np.int64) * self.n + right[rows]
        at = self._place(code)
        while len(rows):
            there = self.pairs[at]
            hit = there == code
            out[rows[hit]] = self.pair_rank[at[hit]]
            on = np.flatnonzero((there >= 0) & ~hit)
            rows, code, at = rows[on], code[on], (at[on] + 1) % len(self.pairs)
        return out

    def cut_all(self, words: list[str], stream: int) -> list[bytes]:
        """The same cuts for many words of like length."""
        key = self._keys(np.array([self._hash(w) for w in words], np.uint64), np.uint64([stream]))
        ids, n, _, _ = self._cut_all(words, key, len(self.id_of))
        return [ids[a:b].astype("<u4").tobytes() for a, b in pairwise([0, *np.cumsum(n).tolist()])]

    def _cut_all(self, words: list[str], key: np.ndarray, skips: int) -> tuple[np.ndarray, ...]:
        """A row a word, the agenda's best place in each row at once; nothing is skipped after so many skips.

        Ids and their number in each row; what the candidates after those skips draw by, and their number.
        """
        none, size = len(self.id_of), np.array([len(w) for w in words])
        width = int(size.max())
        symbols = np.full((len(words), width), -1, np.int32)
        inside = np.arange(width) < size[:, None]
        symbols[inside] = self.char[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        # a merged symbol stays at its first character's place; rows are chains of the places still held
        after = np.tile(np.arange(1, width + 1, dtype=np.int16), (len(words), 1))
        before = after - np.int16(2)
        left = np.full(len(words), skips)
        drawn, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        agenda = np.full((len(words), width), none, np.int32)
        agenda[:, :-1] = self._ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(words), width - 1)
        rows = np.arange(len(words))
        while len(rows):
            open_ = agenda if len(rows) == len(agenda) else agenda[rows]
            at = open_.argmin(axis=1)
            best = open_[np.arange(len(rows)), at]
            on = best < none
            if not on.all():
                rows, at, best = rows[on], at[on], best[on]
            draw = best.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            last = left[rows] == 0
            drawn.append(draw[last])
            owner.append(rows[last])
            skip = self._skips(key[rows] ^ draw) & ~last
            if skip.any():
                left[rows[skip]] -= 1
                agenda[rows[skip], at[skip]] = none
                go, i, new = rows[~skip], at[~skip], self.id_of[best[~skip]].astype(np.int32)
            else:
                go, i, new = rows, at, self.id_of[best].astype(np.int32)
            if not len(go):
                continue
            j = after[go, i]
            k = after[go, j]
            symbols[go, i], symbols[go, j] = new, -1
            agenda[go, j], after[go, i] = none, k
            inner = k < width
            last_k = np.minimum(k, width - 1)
            agenda[go, i] = self._ranks(new, np.where(inner, symbols[go, last_k], -1))
            before[go[inner], k[inner]] = i[inner]
            h = before[go, i]
            has = h >= 0
            agenda[go[has], h[has]] = self._ranks(symbols[go[has], h[has]], new[has])
        n = (symbols >= 0).sum(axis=1)
        flat = symbols[symbols >= 0]
        if (flat >= self.n).any():  # characters as bytes
            raw = [[x] if x < self.n else [self.byte_ids[c] for c in chr(x - self.n).encode()] for x in flat.tolist()]
            row = np.repeat(np.arange(len(words)), n)
            n = np.bincount(row, [len(r) for r in raw], len(words)).astype(np.int64)
            flat = np.array([i for r in raw for i in r], np.int64)
        owner = np.concatenate(owner)
        return flat, n, np.concatenate(drawn)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _grow(self, words: list[str], hashes: np.ndarray, key: np.ndarray, skips: int) -> None:
        """Nodes of these words in this order; they are cut in order of length."""
        order = np.argsort([len(w) for w in words], kind="stable")
        for i in range(0, len(words), BLOCK):
            part = order[i:i + BLOCK]
            named = [words[j] for j in part.tolist()]
            self.tree.add(named, hashes[part], self._cut_all(named, key[part], skips))
        # nodes were added in order of length: put their entries (not what they point to) in the order asked for
        t, first = self.tree, len(self.tree.words) - len(words)
        back = np.argsort(order, kind="stable")
        for rows in (t.draw_at, t.draw_n, t.id_at, t.id_n, t.hash):
            rows.held[first:rows.n] = rows.held[first:rows.n][back]
        t.words[first:] = words

    def _descend(self, node: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The node that the draws of each occurrence end in, from its word's root."""
        t, node, rows, skips = self.tree, node.copy(), np.arange(len(node)), 0
        while len(rows):
            n = t.draw_n.held[node[rows]]
            ends = np.cumsum(n)
            hit = np.flatnonzero(self._skips(np.repeat(key[rows], n) ^ t.draws.held[ragged(t.draw_at.held[node[rows]], n)]))
            of = np.searchsorted(ends, hit, "right")
            first = np.flatnonzero(np.diff(of, prepend=-1))
            hit, of = hit[first], of[first]
            rows, skips = rows[of], skips + 1
            code, one, each = np.unique(node[rows] << 16 | hit - (ends - n)[of], return_index=True, return_inverse=True)
            child = np.array([t.child.get(c, -1) for c in code.tolist()], np.int64)
            new = np.flatnonzero(child < 0)
            if len(new):
                at = rows[one[new]]
                child[new] = np.arange(len(t.words), len(t.words) + len(new))
                t.child.update(zip(code[new].tolist(), child[new].tolist(), strict=True))
                self._grow([t.words[i] for i in node[at].tolist()], t.hash.held[node[at]], key[at], skips)
            node[rows] = child[each]
        return node

    def encode(self, texts: list[str | None], doc_ids: list[int | None]) -> list[bytes]:
        """Flat ids (32 bits each) of whole texts, each led by the model's extra space."""
        out: list[bytes] = []
        for part in by_size(texts, CHARS):
            out += self._encode(part, doc_ids[len(out):len(out) + len(part)])
        return out

    def _encode(self, texts: list[str], doc_ids: list[int | None]) -> list[bytes]:
        if len(self.tree.words) > MEMO:
            self._forget()
        self.roots.next = len(self.tree.words)
        nodes, streams = [], []
        for text, doc in zip(texts, doc_ids, strict=True):
            words = self.words.findall(" " + text) if text else []
            nodes.append(np.fromiter(map(self.roots.__getitem__, words), np.int64, len(words)))
            start = xxhash.xxh64_intdigest(str(-1 if doc is None else doc), self.seed)
            at = np.arange(len(words), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(start)
            at = (at ^ at >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
            streams.append((at >> np.uint64(33)) % np.uint64(self.variants) if self.variants else at ^ at >> np.uint64(32))
        ends = np.cumsum([len(x) for x in nodes])
        node, stream = np.concatenate(nodes), np.concatenate(streams)
        new, long = self.roots.new, self.roots.long
        self.roots.new, self.roots.long = [], []
        if new:
            hashes = np.array([self._hash(w) for w in new], np.uint64)
            self._grow(new, hashes, hashes, 0)
        t, at_long = self.tree, np.flatnonzero(node < 0)
        short = np.flatnonzero(node >= 0)
        node[short] = self._descend(node[short], self._keys(t.hash.held[node[short]], stream[short]))
        at, n, ids = t.id_at.held[node], t.id_n.held[node], t.ids.held
        if len(at_long):
            cuts = [np.array(self.cut(long[-1 - node[i]], int(stream[i])), np.uint32) for i in at_long.tolist()]
            n[at_long] = [len(c) for c in cuts]
            at[at_long] = t.ids.n + np.cumsum(n[at_long]) - n[at_long]
            ids = np.concatenate([t.ids.held[:t.ids.n], *cuts])
        out, sums = [], np.concatenate([[0], np.cumsum(n)])
        flat = ids[ragged(at, n)].astype("<u4", copy=False)
        for a, b in pairwise([0, *ends.tolist()]):
            out.append(flat[sums[a]:sums[b]].tobytes())
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all(ids, np.array([len(ids)]))[0].as_py()

    def decode_all(self, ids: np.ndarray, n: np.ndarray) -> pa.StringArray:
        """Texts of so many ids each: the pieces' bytes gathered from one table, without each text's extra space."""
        if self.flat is None:
            size = np.array([len(p) for p in self.bytes])
            self.flat = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(size) - size, size
        raw, at, size = self.flat
        data = raw[ragged(at[ids], size[ids])]
        ends = np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], np.cumsum(n)])]
        led = np.flatnonzero(n)
        data = np.delete(data, ends[led])
        ends = ends - np.concatenate([[0], np.cumsum(n > 0)])
        return pa.StringArray.from_buffers(len(n), pa.py_buffer(ends.astype("<i4")), pa.py_buffer(data))


_segmenters: dict[tuple, Segmenter] = {}


def segmenter(*args) -> Segmenter:
    """The worker's segmenter for a model and its settings, loaded once."""
    if args not in _segmenters:
        _segmenters[args] = Segmenter(*args)
    return _segmenters[args]


def encode(docs: DataFrame, path: str, seed: int = SEED, dropout: float = DROPOUT, variants: int = VARIANTS,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_pieces`` and ``ids`` (32 bits each, little-endian) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = segmenter(path, seed, dropout, variants)
        for b in batches:
            flat = s.encode(b.column("text").to_pylist(), b.column("doc_id").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(f) // 4 for f in flat], pa.int64()), pa.array(flat, pa.binary())],
                names=["doc_id", "n_pieces", "ids"])
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids binary")


def decode(pieces: DataFrame, path: str) -> DataFrame:
    """``pieces`` with the ``text`` that its ``ids`` (as made by ``encode``) stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = segmenter(path)
        for b in batches:
            at, n, first = 0, pc.fill_null(pc.binary_length(b.column("ids")), 0).to_numpy(zero_copy_only=False) // 4, 0
            sums = np.cumsum(n)
            while first < len(n):  # some of the rows at a time, to bound the bytes gathered at once
                end = max(first + 1, int(np.searchsorted(sums, at + DECODED, "right")))
                part = b.slice(first, end - first)
                ids = np.frombuffer(b"".join(i or b"" for i in part.column("ids").to_pylist()), "<u4")
                texts = s.decode_all(ids, n[first:end])
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*b.schema.names, "text"])
                first, at = end, int(sums[end - 1])
    rows = pieces.drop("text")
    return rows.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, text string")
