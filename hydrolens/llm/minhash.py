"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

A document has two small collections of ``SIDE`` sketches, each of ``HASHES``
minhashes. A table key joins one sketch of either collection, so 84 minhashes
serve 196 tables of six hashes each, which would cost 1,176 if each table had its
own. A pair shares a table if it agrees in some sketch of the first collection and
in some of the second: at a similarity of 0.8 a pair is missed with a chance of
9e-5, at 0.85 of 3e-6.

Equal sets are one node from the start. Rows are dealt to tasks by the sketches
of the first collection and meet those of the second there, so that the table keys
themselves are never shuffled. Each bucket is first tried as a star around its
smallest node; sketches shared by very many documents are split by salt, each
part with a star of its own. Confirmed links merge nodes into components. Only
stars whose nodes are still in different components are looked at again, by the
rarest shingles of their nodes, some of which any linked pair must share (prefix
filter).
So no pair of a bucket that could still join two components goes untested.

Defined results: a NULL or empty text has an empty set, is linked with nothing and
kept; fewer words than a shingle make one shingle; NULL document ids sort before
all others; repeated rows of one document stay or go together (but
``drop_near_duplicates`` keeps a single row); an empty table
gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolens.llm.common import not_null_key

SIDE = 14
HASHES = 3
WORDS = 5
#: Links: 100 times the common shingles are at least so many times all shingles of both.
PERCENT = 80
#: Documents of one sketch that go to one task.
HOT = 20_000
#: Words a worker remembers the hashes of.
MEMO = 500_000
_SKETCH = "k long, h long, n long, copy binary, node long, u array<int>, v array<int>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Hashes()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; A-Z count as a-z."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(_words) > MEMO:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    length = min(words, len(h))
    s = np.full(len(h) - length + 1, np.uint64(length), np.uint64)
    for i in range(length):
        s = (s ^ h[i:len(h) - length + 1 + i]) * _MIX
        s ^= s >> np.uint64(29)
    return np.unique(s)


def _factors() -> np.ndarray:
    rng = np.random.RandomState(5)
    return rng.randint(0, 1 << 62, 2 * SIDE * HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The sketches of both collections, 32 bits each: minhashes, ``HASHES`` of them folded into one."""
    low = np.array([(s * f).min() for f in factors]).reshape(2 * SIDE, HASHES)
    folded = low[:, 0]
    for i in range(1, HASHES):
        folded = (folded ^ folded >> np.uint64(31)) * _MIX + low[:, i]
    folded = (folded ^ folded >> np.uint64(31)) * _MIX
    return (folded >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors()
        for b in batches:
            size, copy, node, both = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, words)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                size.append(len(s))
                copy.append(digest)
                node.append(int.from_bytes(digest[:8], "little", signed=True))
                both.append(sketch(s, factors) if len(s) else np.zeros(2 * SIDE, np.int32))
            rows = np.array(both, np.int32).reshape(-1, 2, SIDE)
            part = lambda i: pa.ListArray.from_arrays(
                pa.array(np.arange(0, (len(rows) + 1) * SIDE, SIDE), pa.int32()), pa.array(rows[:, i].ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), b.column("h"), pa.array(size, pa.int64()), pa.array(copy, pa.binary()),
                 pa.array(node, pa.int64()), part(0), part(1)], names=["k", "h", "n", "copy", "node", "u", "v"])
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                found = [shingles(t, words) for t in b.column("text").slice(i, 500).to_pylist()]
                ends = np.cumsum([0, *map(len, found)])
                flat = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("node").slice(i, 500), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    names=["node", "set"])
    return run


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write and read again: cuts the lineage, in a folder that outlives an executor."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def like_sizes(a: str, b: str) -> Column:
    """Sets of these sizes can reach the similarity at all."""
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b))


def buckets(nodes: DataFrame) -> DataFrame:
    """Rows of nodes that share a table: ``table``, ``node``, ``n``, ``star`` and ``star_n`` (the bucket's smallest node).

    Buckets of a sketch that more than ``HOT`` nodes share come in ``salts`` parts.
    """
    rows = nodes.select("node", "n", "v", F.posexplode("u").alias("i", "x")).select(
        F.xxhash64("i", "x").alias("first"), "node", "n", "v")
    hot = rows.groupBy("first").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select(
        "first", F.ceil(F.col("c") / HOT).cast("int").alias("salts"))
    rows = rows.join(hot, "first", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    near = Window.partitionBy("first", "salt").orderBy("node")
    shared = rows.withColumns({"_a": F.lag("node").over(near), "_b": F.lead("node").over(near)}).where(
        F.col("_a").isNotNull() | F.col("_b").isNotNull() | (F.col("salts") > 1)).drop("_a", "_b")
    full = shared.select("first", "salt", "salts", "node", "n", F.posexplode("v").alias("j", "y"))
    one = Window.partitionBy("first", "salt", "j", "y").orderBy("node")
    found = full.withColumns({
        "star": F.first("node").over(one), "star_n": F.first("n").over(one),
        "_a": F.lag("node").over(one), "_b": F.lead("node").over(one)})
    return found.where(F.col("_a").isNotNull() | F.col("_b").isNotNull() | (F.col("salts") > 1)).select(
        F.xxhash64("first", "j", "y").alias("table"), "salts", "node", "n", "star", "star_n")


def pairs_of(left: str, left_n: str, right: str, right_n: str, rows: DataFrame) -> DataFrame:
    """Distinct pairs, smaller node first, whose sizes allow a link."""
    rows = rows.where(like_sizes(left_n, right_n) & (F.col(left) != F.col(right)))
    return rows.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct()


def star_members(rows: DataFrame) -> DataFrame:
    """Distinct ``star``, ``node`` and their sizes, each star among its own nodes.

    Nodes of one bucket have a star in common, so these pairs stand for the
    buckets, of which there are many more. Parts of a split bucket have the
    smallest of their stars in common too.
    """
    own = rows.select("star", "star_n", "node", "n")
    split = rows.where(F.col("salts") > 1)
    top = split.groupBy("table").agg(F.min(F.struct("star", "star_n")).alias("top"))
    upper = split.join(top, "table").select("top.star", "top.star_n", "node", "n")
    return own.unionByName(upper).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").where(
        100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def components(edges: DataFrame, scratch: str) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of ``edges`` (``a``, ``b``).

    Alternates large and small stars until the edges are stars around the roots:
    each step is a minimum by node and a join, and halves the longest paths.
    """
    def step(e: DataFrame, small: bool, at: str) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        sided = down if small else down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sided.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = saved(low, at)  # written, so that Spark can split a hub
        joined = sided.join(low, "u")
        if small:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.where(F.col("a") != F.col("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, before, turn = edges, None, 0
    while True:
        far = saved(step(now, False, f"{scratch}/{turn}_far_low"), f"{scratch}/{turn}_far")
        now = saved(step(far, True, f"{scratch}/{turn}_low"), f"{scratch}/{turn}")
        if (after := mark(now)) == before:
            break
        before, turn = after, turn + 1
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes of stars of three nodes or more that lie in several components, with their ``root``."""
    known = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    left = known.groupBy("star").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("c")).where(
        (F.col("x") != F.col("y")) & (F.col("c") > 2)).select("star")
    return known.join(left, "star", "left_semi").select("node", "n", "root").distinct()


def _rest(nodes: DataFrame, sets: DataFrame, scratch: str) -> DataFrame:
    """Every pair of nodes of different components that may still be linked.

    Shingles are ranked by how many of the nodes have them, rarest first. Linked
    sets must share one of the shingles that a set can lose and still be similar
    enough, the first of them with enough shingles after it. A pair's shingle is
    looked up from the node outside the component that has it most often.
    """
    each = nodes.join(sets, "node").select("node", "n", "root", F.explode("set").alias("s"))
    # written, so that the join with it has an exchange on either side and Spark can split a shingle that many have
    common = saved(each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), f"{scratch}/common")
    rare = Window.partitionBy("node").orderBy("df", "s")
    ranked = each.join(common, "s").withColumn("at", F.row_number().over(rare))
    # shingles of one node alone come first in its order, and there are as many as are missing here
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("node"))
    lead = ranked.withColumn("at", F.col("at") + alone).where(
        F.col("at") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).drop("df")
    lead = saved(lead, f"{scratch}/lead")
    most = lead.groupBy("s", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("s").agg(
        F.max_by("root", F.struct("c", "root")).alias("most"))
    most = saved(most, f"{scratch}/most")  # as ``common``: a shingle of many near copies is split
    a = lead.join(most, "s").where(F.col("root") != F.col("most")).drop("most")
    a, b = (x.select("s", *[F.col(c).alias(f"{c}_{end}") for c in ("node", "n", "root", "at")])
            for x, end in ((a, "a"), (lead, "b")))
    left = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    both = a.join(b, (a["s"] == b["s"]) & (F.col("root_a") != F.col("root_b")) & like_sizes("n_a", "n_b")
                  & (100 * left >= PERCENT * (F.col("n_a") + F.col("n_b") - left)))
    return both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def links(docs: DataFrame, sketches: DataFrame, scratch: str, words: int) -> DataFrame:
    """``node`` and ``root`` of every node that has a link."""
    nodes = sketches.where("n > 0").select("node", "n", "u", "v", F.struct("k", "h").alias("doc")).dropDuplicates(["node"])
    nodes = saved(nodes, f"{scratch}/nodes")
    rows = saved(buckets(nodes.drop("doc")), f"{scratch}/buckets")
    members = saved(star_members(rows), f"{scratch}/members")
    shown = members.select("node").distinct().join(nodes.select("node", "doc.k", "doc.h"), "node")
    texts = docs.join(shown, ["k", "h"]).select("node", "text").dropDuplicates(["node"])
    sets = saved(texts.mapInArrow(_sets(words), "node long, set array<long>"), f"{scratch}/sets")
    tested = saved(pairs_of("star", "star_n", "node", "n", members), f"{scratch}/pairs0")
    edges = saved(confirmed(tested, sets), f"{scratch}/links0")
    roots = saved(components(edges, f"{scratch}/roots0"), f"{scratch}/found0")
    left = saved(_open(members, roots), f"{scratch}/open")
    pairs = _rest(left, sets, scratch).join(tested, ["a", "b"], "left_anti")
    more = saved(confirmed(pairs, sets), f"{scratch}/links1")
    return roots if more.isEmpty() else components(edges.unionByName(more), f"{scratch}/roots1")


def near_duplicates(docs: DataFrame, scratch: str, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id it is linked to, by however
    many steps) and ``kept`` (that id is its own). To tell rows of one id apart: ``text_hash``, and ``first``
    (of its component, by id and text hash).

    ``scratch``: folder in the shared store for sketches, candidate pairs and the steps of the components.
    """
    keyed = docs.select(not_null_key(doc_id).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    sketches = saved(keyed.mapInArrow(_sketches(words), _SKETCH), f"{scratch}/sketches")
    roots = links(keyed, sketches, scratch, words)
    # equal sets first, then components: neither gathers more than a minimum by key
    sets = sketches.where("n > 0").groupBy("node").agg(F.min(F.struct("k", "h")).alias("low")).join(roots, "node", "left")
    sets = sets.withColumn("root", F.coalesce("root", "node"))
    sets = saved(sets, f"{scratch}/roots")
    # written, so that the join with it has an exchange on either side and a large component is split
    lowest = saved(sets.groupBy("root").agg(F.min("low").alias("first")), f"{scratch}/lowest")
    out = sketches.select("k", "h", "n", "node").join(sets.join(lowest, "root").select("node", "first"), "node", "left")
    out = out.withColumn("first", F.when(F.col("n") > 0, F.col("first")).otherwise(F.struct("k", "h")))
    known = lambda c: F.when(c != -(1 << 63), c)
    return out.select(
        known(F.col("k")).alias("doc_id"), F.col("n").alias("n_shingles"), known(F.col("first.k")).alias("component_id"),
        (F.col("k") == F.col("first.k")).alias("kept"), F.col("h").alias("text_hash"),
        (F.struct("k", "h") == F.col("first")).alias("first"))


def drop_near_duplicates(docs: DataFrame, scratch: str, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that are near copies of a kept one; one row of each group stays."""
    judged = near_duplicates(docs, scratch, words, doc_id, text)
    stay = judged.where("first").select(not_null_key("doc_id").alias("k"), F.col("text_hash").alias("h"),
                                        (F.col("n_shingles") > 0).alias("full")).distinct()
    rows = docs.select(F.struct("*").alias("row"), not_null_key(doc_id).alias("k"), F.xxhash64(text).alias("h"))
    again = F.row_number().over(Window.partitionBy("k", "h").orderBy("full"))
    return rows.join(stay, ["k", "h"]).withColumn("again", again).where("again = 1 OR NOT full").select("row.*")
