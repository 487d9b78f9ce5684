"""Cases of the third round: open heads, titles, clashing columns in the pipeline, damaged and many archives."""
import io

import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from hydrolens.llm import html_density, line_dedup, quality, warc

BODY = "The river rises in the hills and runs through three old towns before it reaches the sea. " * 6
TEXT = " ".join(BODY.split())


def test_a_head_without_end_tag():
    for start in ("<html><head><title>x</title><body>", "<head><title>x</title><meta charset=utf-8>", "<html><head><style>p{}</style>\n",
                  "<html><head><title>x</title></head><body>"):
        assert html_density.extract(f"{start}<article><p>{BODY}</p></article></body></html>") == TEXT
    assert html_density.extract(f"<head><title>x</title>{BODY}") == TEXT
    assert html_density.extract(f"<head><script>var a = '<p>';</script><title>x</title></head><p>{BODY}</p>") == TEXT


def test_title_and_byline_without_a_landmark():
    page = f"<body><div id=main><h1>On rivers</h1><div class=meta>By Kim, in May</div><div class=body><p>{BODY}</p><p>{BODY}</p></div></div></body>"
    assert html_density.extract(page) == f"On rivers By Kim, in May {TEXT} {TEXT}"
    site = f"<body><h1>Site</h1><div class=body><p>{BODY}</p><p>{BODY}</p></div><div><a href=/x>More</a></div></body>"
    assert html_density.extract(site) == f"{TEXT} {TEXT}"  # a heading of the whole page is no title


def test_first_stages_keep_columns_named_like_their_measures(spark, tmp_path):
    good = "the old mill by the river is open to all who walk in the valley and like bread"
    rows = [(i, f"{good}\nline number {i} of the page", f"s{i}", "mine", True, 7, 8, "f") for i in range(12)]
    rows += [(99, "too short", "s1", "mine", True, 7, 8, "f"), (None, None, None, None, None, None, None, None)]
    kind = "doc_id long, text string, source string, n_words string, kept boolean, n_lines int, n_removed int, failed string"
    docs = spark.createDataFrame(rows, kind)
    kept = quality.passing(docs)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == set(range(12))
    assert sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[0] in range(12))
    judged = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert judged == set(range(12))
    out = corpus_pipeline.boilerplate_lines(spark, kept, str(tmp_path))
    assert out.columns == docs.columns
    found = {r.doc_id: r for r in out.collect()}
    assert all((r.n_words, r.kept, r.n_lines, r.n_removed, r.failed) == ("mine", True, 7, 8, "f") for r in found.values())
    assert [good in found[i].text for i in range(12)] == [True] + [False] * 11
    named = line_dedup.dedup_lines(kept, f"{tmp_path}/lines", counts=("a", "b")).agg(F.sum("a"), F.sum("b")).first()
    assert tuple(named) == (24, 11)


def _frames(raw):
    return [warc._row("a", at, body, error) for at, body, error in warc.frames(io.BytesIO(raw))]


def test_reading_goes_on_after_a_damaged_frame():
    import random
    noise = random.Random(5)
    pages = [noise.randbytes(3000) + b"\x28\xb5\x2f\xfd" * 3 + noise.randbytes(2000) for _ in range(5)]
    press = zstandard.ZstdCompressor(write_checksum=True)
    parts = [press.compress(warc.page_record(i, "http://x/", p, warc.hashlib.sha256(p).hexdigest(), None)) for i, p in enumerate(pages)]
    starts = [sum(map(len, parts[:i])) for i in range(5)]
    for spoil in (lambda b: b"\0\0\0\0" + b[4:], lambda b: b[:900] + bytes(80) + b[980:], lambda b: b[:200], lambda b: b[:-1] + b"?"):
        raw = b"".join([*parts[:2], spoil(parts[2]), *parts[3:]])
        rows = _frames(raw)
        assert [r[6] for r in rows if r[9] is None] == [pages[i] for i in (0, 1, 3, 4)] and sum(r[9] is not None for r in rows) == 1
        assert rows[2][1] == starts[2] and all(raw[r[1]:r[1] + 4] == warc.MAGIC for r in rows if r[9] is None)
    assert [r[9] is None for r in _frames(b"".join(parts) + b"rubbish at the end")] == [True] * 5 + [False]


def test_archives_follow_a_size_and_a_frequent_page_is_split(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "<p>" + "same page " * 30 + "</p>" if i % 3 else f"<p>page {i * 7919} {'word ' * 40}</p>") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    made = warc.write_archives(pages, f"{tmp_path}/w", archive_bytes=4000)
    sizes = [r.n_bytes for r in made.collect()]
    assert len(sizes) > 6 and made.agg(F.sum("n_records")).first()[0] == 400
    records = warc.read_archives(made).where("record_type != 'warcinfo' OR error IS NOT NULL")
    got = {r.page: r for r in records.select("*", warc.page_ids("record_id").alias("page"), warc.page_ids("refers_to").alias("to")).collect()}
    assert len(got) == 400 and all(r.error is None for r in got.values())
    assert all((r.record_type, r.to) == (("revisit", 1) if p % 3 and p != 1 else ("response", None)) for p, r in got.items())
