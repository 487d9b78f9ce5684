"""Quality rules, line dedup, merge-dropout and fingerprints against brute force, on hand-made edge rows."""
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from hydrolens.llm import fuzzy_hash, line_dedup, quality
from hydrolens.llm import sentencepiece_dropout as sp

SPACE = re.compile(r"[\x20\x09-\x0D]+")
GOOD = "The meter of the house is read in the morning and it is not a task for the evening."

ROWS = [
    (1, GOOD, "a"), (2, None, "a"), (None, GOOD, None), (3, "", "b"), (4, "one two", "b"),
    (5, "buy now best price here " * 8, "c"), (6, "a b c d e a b c d e x a b c d e", "d"),
    (7, "\n".join([GOOD] * 5), "e"), (8, "word### $$$ %% && ** || <> # # #" * 4, "f"),
    (9, "ALL THE WORDS OF THIS TEXT ARE WRITTEN IN CAPITAL LETTERS NOW", "g"), (10, GOOD, "h"), (10, GOOD, "h"),
    (11, "\t \n \x0b", "i"), (12, " ".join(f"w{i % 5000} the" for i in range(30_000)), "j"), (13, "é ü x ﬁ " * 6, "k"),
    (14, "x" * 200_000, "l"),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    for c in ("kept", "n_lines", "n_words", "k", "t", "h", "pos", "_w", "fingerprint", "__x"):  # names the operators use
        frame = frame.withColumn(c, F.lit(f"old {c}"))
    return frame.repartition(4)


def repeated(words):
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    return len({i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(5)})


def test_quality_measures_equal_brute_force(docs):
    rows = quality.judge(docs).select("doc_id", "text", *quality.MEASURES, "base_failed", "kept", "failed", "h", "_w").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        t = r.text or ""
        words = [w for w in SPACE.split(t) if w]
        lines = [x for x in t.split("\n") if SPACE.sub("", x)]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_lines == len(lines)
        assert r.n_repeat_words == repeated(words)
        assert r.base_failed == (len(words) < 10 or 100 * repeated(words) > 20 * len(words))
        assert not (r.base_failed and r.kept) and r.kept == (r.failed == [])
        assert (r.h, r._w) == ("old h", "old _w")


def test_quality_verdicts(docs):
    failed = {r.doc_id: r.failed for r in quality.judge(docs).collect()}
    assert failed[1] == failed[10] == failed[None] == []
    assert "words" in failed[2] and "words" in failed[3]
    assert "symbols per word" in failed[8] and "words in capitals" in failed[9]
    assert "repeated lines" in failed[7] and "mean word length" in failed[14]


RUSSIAN = "Вода в реке течёт к морю, и старый мост стоит над ней уже сто лет; дети бегут по берегу утром. " * 3
CHINESE = "。".join(f"第{i}天早上人们沿着河边走到市场去买面包和水果然后回家" for i in range(12)).replace("面包", " 面包 ")
POLISH = " ".join(f"rzeka{i} płynie przez stare miasto i wpada do morza koło wsi{i}" for i in range(8))


def test_quality_language_rules_leave_other_languages_alone(spark):
    rows = [(1, RUSSIAN.replace("; дети", f" {'и ещё раз '}; дети"), None), (2, CHINESE, "zh"), (3, POLISH, "pl"), (4, POLISH, "en"),
            (5, POLISH, None), (6, CHINESE, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    failed = {r.doc_id: set(r.failed) - {"repeated words"} for r in quality.judge(docs).collect()}
    assert failed == {1: set(), 2: set(), 3: set(), 4: {"stop words"}, 5: {"stop words"}, 6: set()}
    bare = {r.doc_id: set(r.failed) - {"repeated words"} for r in quality.judge(docs.drop("lang")).collect()}
    assert bare == {1: set(), 2: set(), 3: {"stop words"}, 4: {"stop words"}, 5: {"stop words"}, 6: set()}
    assert quality.judge(docs.limit(0)).count() == 0 and quality.passing(docs.limit(0)).count() == 0


def test_quality_plan_is_one_projection(docs):
    plan = quality.judge(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "Aggregate [" not in plan


def lines_by_hand(rows, least):
    strip = lambda x: x.strip(" \t\n\x0b\f\r")
    sites, first, often = {}, {}, Counter()
    for doc, text, site in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, x in enumerate((text or "").split("\n")):
            if strip(x):
                sites.setdefault(strip(x), set()).add(site)
                often[strip(x)] += 1
                first.setdefault(strip(x), (doc, i))
    out = []
    for doc, text, _ in rows:
        all_lines = (text or "").split("\n")
        full = [i for i, x in enumerate(all_lines) if strip(x)]
        gone = [i for i in full if len(sites[strip(all_lines[i])] - {None}) >= least and first[strip(all_lines[i])] != (doc, i)]
        gone = [i for i in gone if len(strip(all_lines[i]).split()) >= line_dedup.SHORT
                or often[strip(all_lines[i])] * line_dedup.SHARE >= len(rows)]
        chars = lambda at: sum(len(strip(all_lines[i])) for i in at)  # noqa: E731,B023
        gone = [] if 5 * chars(gone) >= 4 * chars(full) else gone
        cut = "\n".join(x for i, x in enumerate(all_lines) if i not in gone) if gone else text
        out.append((-1 if doc is None else doc, cut, len(full), len(gone)))
    return sorted(out, key=repr)


def site_rows():
    rows = [(i, f"own line {i}\n  cookie notice\nshared by {i % 4}\n\ncookie notice", f"site{i % 12}") for i in range(40)]
    rows += [(40, "cookie notice", "site1"), (41, None, "site2"), (None, "cookie notice\nno id", "site3"), (42, "", None),
             (43, "only null sites", None), (44, "only null sites\nown", None), (45, "last\nlast", "site1")]
    rows += [(50 + i, f"edge {i}\nnear the threshold", f"site{i}") for i in range(5)]
    return rows


@pytest.mark.parametrize("least", [3, 5, 6, 12])
def test_line_dedup_equals_brute_force(spark, tmp_path, least):
    rows = site_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    for c in ("k", "t", "h", "pos", "n_lines"):
        frame = frame.withColumn(c, F.lit(7))
    out = line_dedup.dedup_lines(frame, f"file://{tmp_path}/s", min_sites=least)
    assert set(out.columns) == {*frame.columns, "n_removed"} and out.where("k = 7 AND t = 7 AND pos = 7").count() == len(rows)
    found = [(-1 if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()]
    assert sorted(found, key=repr) == lines_by_hand(rows, least)


def test_line_dedup_repeated_rows_and_empty_table(spark, tmp_path):
    rows = [(i, "same\nown", f"s{i}") for i in range(9)] + [(9, "same\nmine", "s9")] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = line_dedup.dedup_lines(frame, f"file://{tmp_path}/a").where("doc_id = 9").collect()
    assert [r.text for r in out] == ["mine", "mine"]
    assert line_dedup.dedup_lines(frame.limit(0), f"file://{tmp_path}/b").count() == 0


def test_line_dedup_keeps_near_copies_whole_and_short_chance_lines(spark, tmp_path):
    same = "\n".join(f"line {i} of the story that nine sites print alike" for i in range(6))
    rows = [(i, f"{same}\nown {i}", f"s{i}") for i in range(9)]
    notice = "This page is shown to you under the terms of use."
    rows += [(100 + i, f"The.\n{notice}\nstory {i} has a long line of its own about things seen in place {i}" if i < 12 else
              f"story {i} has two lines of its own\nand no other line than those", f"s{i % 20}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(frame, f"{tmp_path}/near").collect()}
    assert all(out[i].text == rows[i][1] and out[i].n_removed == 0 for i in range(9))  # near copies are left to near-dedup
    assert all("The." in out[100 + i].text for i in range(12))  # 12 of 409 documents: no boilerplate
    assert [notice in out[100 + i].text for i in range(12)] == [True] + [False] * 11


def test_line_dedup_counts_near_the_threshold_exactly():
    low, high = line_dedup.near(8)
    assert low <= 7 and high >= 9
    low, high = line_dedup.near(1000)
    assert high - 1000 > 100


def test_merge_dropout_round_trip(spark, docs):
    out = sp.decode(sp.encode(docs, sp.model_path()), sp.model_path()).collect()
    want = Counter((r[0], r[1] or "") for r in ROWS)
    assert Counter((r.doc_id, r.text) for r in out) == want
    same = [r.ids for r in out if r.doc_id == 10]
    assert same[0] == same[1] and len({bytes(r.ids) for r in out if r.text == GOOD}) > 1
    assert sp.encode(docs.limit(0), sp.model_path()).count() == 0


def test_no_dropout_is_the_library():
    s, library = sp.Segmenter(sp.model_path(), 1, 0.0, 1), sentencepiece.SentencePieceProcessor(model_file=sp.model_path())
    texts = [r[1] for r in ROWS if r[1]] + ["a  b", " a ", "日本語 text\n\n x", "ﬁ​", "tab\there", "a" * 300]
    for t, ids in zip(texts, s.encode(texts, [0] * len(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_blocks_cut_as_single_words(dropout):
    s = sp.Segmenter(sp.model_path(), 9, dropout, 2)
    words = sorted({w for r in ROWS if r[1] for w in s.words.findall(" " + r[1]) if len(w) <= sp.SHORT} | {" ▁x▁", "\t", "日本", "  "},
                   key=len)
    assert s.cut_all(words, 1) == [np.array(s.cut(w, 1), "<u4").tobytes() for w in words]
    if dropout == 1.0:
        assert all(len(s.cut(w, 1)) >= len(w) for w in words)


def occurrences(s, word, count):
    """Cuts of a word that stands often in a text."""
    ids = np.frombuffer(s.encode([" ".join([word] * count)], [5])[0], "<u4").tolist()
    text, starts = "", []
    for at, i in enumerate(ids):
        starts += [at] if len(text) % (len(word) + 1) == 0 else []
        text += s.bytes[i].decode()
    return [tuple(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]


def test_every_occurrence_draws_for_itself():
    s = sp.Segmenter(sp.model_path(), dropout=0.1)
    assert len(set(occurrences(s, "international", 20_000))) > 100
    for word in ("is", "of", "at", "on", "de", "la"):  # one letter pair after the space: the draws show in the cuts
        cuts = Counter(occurrences(s, word, 20_000))
        first = max(cuts, key=cuts.get)
        assert len(cuts) > 1 and 0.08 < 1 - cuts[first] / 20_000 < 0.28


@pytest.mark.parametrize("dropout", [0.1, 0.6])
@pytest.mark.parametrize("memo", [0, 10**6])
def test_remembered_cuts_are_those_of_single_words(monkeypatch, dropout, memo):
    monkeypatch.setattr(sp, "MEMO", memo)
    asked = []
    s = sp.Segmenter(sp.model_path(), 3, dropout)
    texts = [r[1][:3000] for r in ROWS if r[1]] + ["▁a ▁ b é 日本" * 9, "y" * 60 + " of " + "z" * 50] + [GOOD] * 40
    monkeypatch.setattr(s, "_keys", lambda h, x, f=s._keys: asked.append((h.tolist(), x.tolist())) or f(h, x))
    got = [s.encode([t], [i])[0] for i, t in enumerate(texts)]
    monkeypatch.undo()
    streams = {}
    for hashes, numbers in asked:
        for h, x in zip(hashes, numbers, strict=True):
            streams.setdefault(h, []).append(x)
    for t, ids in zip(texts, got, strict=True):
        one = [i for w in s.words.findall(" " + t) for i in s.cut(w, streams[s._hash(w)].pop(0))]
        assert np.frombuffer(ids, "<u4").tolist() == one


def test_lossless_on_odd_texts():
    s = sp.Segmenter(sp.model_path(), dropout=0.3)
    odd = ["▁a ▁ b", "  x\n\n y \n", "a" * 5000, " ", "\n", "日本 é\t\x00z", "😀" * 200, " ▁", "", None]
    assert [s.decode(np.frombuffer(i, "<u4")) for i in s.encode(odd, list(range(len(odd))))] == [t or "" for t in odd]


def test_seed_changes_the_cuts():
    a, b = (sp.Segmenter(sp.model_path(), seed) for seed in (1, 2))
    assert a.encode([GOOD], [1]) != b.encode([GOOD], [1]) and a.encode([GOOD], [1]) == a.encode([GOOD], [1])


def edited_by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, following = text or "", following or ""
        n = len(text) // 4
        out.append((doc, text[:len(text) - n] + following[:n], fuzzy_hash.fingerprint(following)))
    return out


@pytest.mark.parametrize("count", [1, 2, 300])
def test_fingerprints_with_next(spark, count):
    rng = np.random.RandomState(1)
    rows = [(int(i) * 7, " ".join(rng.choice(GOOD.split(), rng.randint(0, 300)))) for i in range(count)]
    rows += [(None, None), (3, ""), (4, "é" * 50_000)] if count == 300 else []
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = [(r.doc_id, r.edited, r.next_fingerprint) for r in fuzzy_hash.with_next(frame).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(found, key=key) == edited_by_hand(rows)


def test_fingerprints_of_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b c")] * 5, "doc_id long, text string")
    rows = fuzzy_hash.with_next(frame).collect()
    assert len(rows) == 5 and {r.fingerprint for r in rows} == {fuzzy_hash.fingerprint("a b c")}
    assert fuzzy_hash.with_next(frame.limit(0)).count() == 0


def test_fingerprint_signatures_cover_whole_texts(docs):
    rng = np.random.RandomState(2)
    for size in (1, 7, 100, 5_000, 200_000):
        text = "".join(rng.choice(list("abcdefghij ")) for _ in range(size))
        level, one, two = fuzzy_hash.fingerprint(text).split(":")
        assert 1 <= len(one) <= 64 and len(two) <= len(one)
        changed = text[:-1] + ("X" if text[-1] != "X" else "Y")
        assert fuzzy_hash.fingerprint(changed) != "0::" and (fuzzy_hash.fingerprint(changed) != fuzzy_hash.fingerprint(text) or size > 1)
    assert fuzzy_hash.fingerprint("ab" * 60_000).count(":") == 2
    out = fuzzy_hash.fingerprints(docs)
    assert out.count() == len(ROWS) and out.where("h = 'old h'").count() == len(ROWS)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def like_by_hand(a, b):
    if a == b:
        return 1.0
    (x, x1, x2), (y, y1, y2) = a.split(":"), b.split(":")
    score = lambda s, t: 1 - distance(s, t) / max(len(s), len(t)) if s or t else 0.0
    gap = int(x) - int(y)
    return {0: max(score(x1, y1), score(x2, y2)), 1: score(x1, y2), -1: score(x2, y1)}.get(gap, 0.0)


def test_likeness_is_edit_distance(spark):
    rng = np.random.RandomState(4)
    base = " ".join(rng.choice(GOOD.split(), 900))
    texts = [base, base[:3000], base + " and more", base[:2000] + base[2100:], "x", "", base * 2, base * 3, GOOD]
    marks = [fuzzy_hash.fingerprint(t) for t in texts]
    pairs = [(a, b) for a in marks for b in marks]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", fuzzy_hash.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    for r in rows:
        assert r.x == pytest.approx(like_by_hand(r.a, r.b)) and 0 <= r.x <= 1
    like = {(r.a, r.b): r.x for r in rows}
    assert like[marks[0], marks[2]] > 0.9 and like[marks[0], marks[3]] > 0.6 and like[marks[0], marks[5]] == 0
