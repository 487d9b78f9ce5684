"""Near-duplicates against all pairs, components against a walk, and the pipeline end to end."""
import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from hydrolens.llm import minhash
from hydrolens.llm.common import byte_bpe_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORDS = [f"word{i}" for i in range(3000)]


def edited(rng, words, share):
    words = list(words)
    for i in rng.sample(range(len(words)), int(len(words) * share)):
        words[i] = rng.choice(WORDS)
    return words


def corpus(seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 250)))) for i in range(120)]
    for i in range(0, 60, 2):  # copies, and copies with some words exchanged
        rows.append((1000 + i, rows[i][1].upper()))
        rows.append((2000 + i, " ".join(edited(rng, rows[i][1].split(), rng.choice([0.02, 0.04, 0.06, 0.1])))))
    base = rng.choices(WORDS, k=150)
    for i in range(150):  # one large group around the threshold
        rows.append((5000 + i, " ".join(edited(rng, base, rng.choice([0.01, 0.03, 0.05, 0.08])))))
    rows += [(9000 + i, rows[0][1]) for i in range(200)]  # one large group of copies
    rows += [(7000, None), (7001, ""), (7002, " \n"), (7003, "one"), (7004, "ONE"), (7005, "one two"), (7006, "É é"),
             (7007, " ".join(rng.choices(WORDS, k=60_000))), (7008, "x" * 100_000)]
    rng.shuffle(rows)
    return rows


def sets_by_hand(text, k):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x0b\x0c\n\r\t":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def by_hand(rows, k):
    sets = {i: sets_by_hand(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and find(a) != find(b):
                common = len(x & y)
                if 100 * common >= 80 * (len(x) + len(y) - common):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("k, hot", [(2, 20_000), (5, 20_000), (2, 20)])
def test_components_equal_all_pairs(spark, tmp_path, monkeypatch, k, hot):
    monkeypatch.setattr(minhash, "HOT", hot)  # 20: sketches of the large group are split by salt
    rows = corpus(k)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for c in ("k", "h", "n", "node", "root"):
        frame = frame.withColumn(c, F.lit("mine"))
    out = minhash.near_duplicates(frame, f"file://{tmp_path}/x", words=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == by_hand(rows, k)


def test_null_ids_repeated_rows_and_empty_table(spark, tmp_path):
    text = " ".join(WORDS[:40])
    rows = [(None, text), (5, text), (5, text), (6, text + " more"), (7, None), (7, None), (8, "a b c d e f"), (8, "g h i j k l")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__full", F.lit(1))
    out = minhash.near_duplicates(frame, f"file://{tmp_path}/a").collect()
    found = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in out))
    assert found == [(0, 0, True), (5, 0, False), (5, 0, False), (6, 0, False), (7, 7, True), (7, 7, True), (8, 8, True), (8, 8, True)]
    stay = minhash.drop_near_duplicates(frame, f"file://{tmp_path}/b").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in stay) == [
        (0, text), (7, ""), (7, ""), (8, "a b c d e f"), (8, "g h i j k l")] and stay[0]["__full"] == 1
    again = frame.where("doc_id = 5")
    assert minhash.drop_near_duplicates(again, f"file://{tmp_path}/c").count() == 1
    assert minhash.near_duplicates(frame.limit(0), f"file://{tmp_path}/d").count() == 0


def test_tables_find_pairs_at_the_threshold():
    factors, rng = minhash._factors(), np.random.RandomState(3)
    missed = 0
    for _ in range(400):
        x = rng.randint(0, 1 << 62, 180).astype(np.uint64)
        a, b = np.unique(x[:162]), np.unique(np.concatenate([x[18:162], x[162:]]))  # 144 of 180
        s, t = (minhash.sketch(y, factors) for y in (a, b))
        same = s == t
        missed += not (same[:minhash.SIDE].any() and same[minhash.SIDE:].any())
    assert missed <= 1


def test_components_of_chains_and_stars(spark, tmp_path):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(500, 490), (490, 510), (-5, -7)]
    edges += [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(80)]
    edges = [e for e in edges if e[0] != e[1]]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for n in sorted(near):
        walk = [n]
        while walk:
            x = walk.pop()
            if x not in want:
                want[x] = n
                walk += near[x]
    out = minhash.components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}/c").collect()
    assert {r.node: r.root for r in out} == want and len(out) == len(want)


@pytest.fixture(scope="module")
def crawl():
    rng = random.Random(9)
    stop = "the of and to a in is it that for".split()
    text = lambda: "\n".join(" ".join(rng.choices(WORDS + stop * 150, k=30)) + "." for _ in range(4))
    rows = [(i, text(), "en", f"site{i % 15}", 0) for i in range(80)]
    notice = "This page is shown to you under the terms of the common water licence."
    rows += [(100 + i, f"{text()}\n{notice}", "en", f"site{i % 15}", 0) for i in range(30)]
    rows += [(200 + i, rows[i][1] + " end", "en", "site0", 0) for i in range(10)]
    rows += [(300, None, "en", "site1", 0), (301, "", "en", "site1", 0), (302, "### $$$ " * 20, "en", None, 0),
             (303, "same same same same same " * 9, None, "site2", 0)]
    return rows, notice


def test_pipeline_stages(spark, tmp_path, crawl):
    rows, notice = crawl
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).write.parquet(
        f"{tmp_path}/documents.parquet")
    docs = first = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out_{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/out_{name}")
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert [df.columns for df in list(seen.values())[:-1]] == [first.columns] * 3
    assert ids["quality_rules"] == {r[0] for r in rows if r[0] < 300} == ids["line_dedup"]
    lined = seen["line_dedup"]
    assert lined.where(F.col("text").contains(notice)).count() == 1 and lined.where(F.length("text") != F.col("n_chars")).count() == 0
    assert ids["near_dedup"] == {r[0] for r in rows if r[0] < 200} == ids["packing"]
    library = Tokenizer.from_file(byte_bpe_path())
    want = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 0] for r in seen["near_dedup"].collect()}
    pieces = sorted(seen["packing"].collect(), key=lambda r: (r.doc_id, r.start))
    found = defaultdict(list)
    for p in pieces:
        found[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
    assert found == want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
