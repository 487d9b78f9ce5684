"""WARC archives, URL verdicts and main text of web pages."""
import hashlib
import io
import math
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from hydrolens.llm import html_density, url_filter, warc

LONG = "<p>" + "water " * 40 + "</p>"
PAGES = [
    (1, "http://a.example.com/", LONG), (2, "http://b.example.com/x", LONG), (3, None, None), (4, "", ""),
    (5, "http://c/\r\nInjected: 1", "short"), (6, "http://d/", "short"), (None, "http://e/", LONG),
    (7, "http://f/é ü", "é" * 50), (8, "http://f/2", "é" * 50), (9, "http://g/", "x" * 3_000_000),
    (10, "http://h/", "a\r\n\r\nWARC/1.1\r\n\r\n"), (10, "http://h/", "a\r\n\r\nWARC/1.1\r\n\r\n"), (0, "http://z/", LONG),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("mine")).repartition(3)


def archived(pages, folder):
    return warc.read_archives(warc.write_archives(pages, folder)).where("record_type != 'warcinfo' OR error IS NOT NULL").select(
        warc.page_ids("record_id").alias("page_id"), "payload", "payload_bytes", "payload_digest", "record_type",
        warc.page_ids("refers_to").alias("refers_to"), "target_uri", "error")


def test_warc_round_trip(pages, tmp_path):
    rows = archived(pages, f"file://{tmp_path}/w").collect()
    assert len(rows) == len(PAGES) and not any(r.error for r in rows)
    key = lambda r: (r[0] is not None, r[0] or 0)
    first = {}
    for i, _, html in PAGES:
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    for r, (i, _, html) in zip(sorted(rows, key=key), sorted(PAGES, key=key), strict=True):
        raw = (html or "").encode()
        digest = hashlib.sha256(raw).hexdigest()
        assert (r.page_id, r.payload_bytes, r.payload_digest) == (i, len(raw), digest)
        revisit = raw in first and first[raw] != i
        assert (r.record_type, r.refers_to) == (("revisit", first[raw]) if revisit else ("response", None))
        assert r.payload == (None if revisit else raw)


def test_warc_without_dictionary_and_of_no_pages(pages, spark, tmp_path):
    few = pages.where("page_id IN (1, 2)")
    assert warc.train(few) == b"" and archived(few, f"file://{tmp_path}/a").count() == 2
    assert archived(pages.limit(0), f"file://{tmp_path}/b").count() == 0


def archive(records, dictionary=b"", packed=True):
    given = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    out = b""
    if dictionary:
        held = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
        out += struct.pack("<II", warc.DICTIONARY_FRAME, len(held)) + held
    return out + b"".join(zstandard.ZstdCompressor(**given).compress(r) for r in records)


def read(raw):
    return [warc._row("a", at, body, error) for at, body, error in warc.frames(io.BytesIO(raw))]


@pytest.fixture(scope="module")
def dictionary():
    return zstandard.train_dictionary(4096, [f"<html><p>page {i} of water {i * 7}</p></html>".encode() * 5 for i in range(200)]).as_bytes()


@pytest.mark.parametrize("packed", [True, False])
def test_dictionary_frame(dictionary, packed):
    body = b"<html><p>page 3</p></html>"
    digest = hashlib.sha256(body).hexdigest()
    raw = archive([warc.page_record(i, "http://x/", body, digest, None) for i in range(3)], dictionary, packed)
    rows = read(raw)
    assert [r[6] for r in rows] == [body] * 3 and rows[0][1] == raw.index(b"\x28\xb5\x2f\xfd", 8 + struct.unpack("<I", raw[4:8])[0])
    other = struct.pack("<II", 0x184D2A50, 5) + b"other"
    assert [r[6] for r in read(raw + other + archive([]))] == [body] * 3


def test_what_does_not_hold_is_reported(dictionary):
    body, good = b"b" * 200, hashlib.sha256(b"b" * 200).hexdigest()
    fine = warc.page_record(1, "http://x/", body, good, None)
    for spoil, said in [
        (lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), "version"),
        (lambda r: r.replace(b"WARC-Date: ", b"X-Date: "), "WARC-Date"),
        (lambda r: r[:-5] + b"\r\n\r\n", "Content-Length"),
        (lambda r: r.replace(b"\r\nWARC-Type", b"\r\nno colon\r\nWARC-Type"), "without a name"),
        (lambda r: r.replace(good.encode(), b"0" * 64), "digest"),
        (lambda r: r.replace(b"HTTP/1.1 200", b"HTML/1.1 200"), "HTTP head"),
    ]:
        rows = read(archive([fine, spoil(fine), fine]))
        assert [bool(r[9]) for r in rows] == [False, True, False] and said in rows[1][9]
    whole = archive([fine, fine], dictionary)
    assert read(whole[:-3])[-1][9] == "archive ends inside a frame" and read(whole[:5])[-1][9]
    assert "damaged" in read(whole[:-40] + b"\x00" * 40)[-1][9]
    assert "revisit" in read(archive([warc.page_record(2, None, body, good, 1).replace(b"WARC-Refers-To", b"X-Refers-To")]))[0][9]


URLS = ["http://a.example.com/en/1", "http://www.example.com/en/", "https://example.com/en/x?y=1", "http://EXAMPLE.com/EN/",
        "http://x.net/es/1", "http://x.net/fr/", "http://x.net/de/", "http://notexample.com", "http://com/", "http://com",
        "http://b.www.example.com/en/a#f", "no scheme", None, "", "http://", "http://net/es/?q", "x://y://z.com/p",
        "http://É.com/é", "http://user@x.com:80/p", "http://xnet/es/"]


def by_hand(url):
    u = url or ""
    if "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_rules_equal_brute_force(spark):
    model = url_filter.fit(url_filter.labelled(spark))
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit("old"))
    rows = url_filter.judge(frame, model).orderBy("page_id").collect()
    for r in rows:
        host, path, rule, verdict = by_hand(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.p_block >= 0.5 else "allow"))
    assert url_filter.judge(frame.limit(0), model).count() == 0
    assert "Python" not in url_filter.judge(frame, model)._jdf.queryExecution().executedPlan().toString()


def right():
    return F.avg(((F.col("verdict") == "block") == (F.col("label") == 1)).cast("int"))


def test_url_model_on_held_out_hosts(spark):
    rows = url_filter.labelled(spark).withColumn("part", F.pmod(F.xxhash64(url_filter.host_and_path(F.col("url"))["host"]), F.lit(4)))
    for part in range(4):
        model = url_filter.fit(rows.where(F.col("part") != part).drop("part"))
        held = url_filter.judge(rows.where(F.col("part") == part), model, rules=())
        assert held.agg(right()).first()[0] >= 0.9


@pytest.mark.parametrize("end", ["net", "org", "co.uk"])
def test_url_model_on_held_out_endings(spark, end):
    rows, with_end = url_filter.labelled(spark), F.col("url").rlike(rf"://[^/]*\.{end}(/|$)")
    held = url_filter.judge(rows.where(with_end), url_filter.fit(rows.where(~with_end)), rules=())
    shares = {r.label: r[1] for r in held.groupBy("label").agg(right()).collect()}
    assert set(shares) == {0.0, 1.0} and min(shares.values()) >= 0.9


def test_url_model_judges_by_words(spark):
    urls = {"https://casino.org/play": "block", "http://buy-cheap.org/pills": "block", "https://www.example.net/": "allow",
            "https://water.example.net/docs/guide": "allow", "https://www.nature.com/articles/physics": "allow",
            "http://free-bets.org/": "block", "https://" + "river." * 20_000 + "org/" + "museum/" * 20_000: "allow"}
    model = url_filter.fit(url_filter.labelled(spark))
    rows = url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), model, rules=()).collect()
    assert {r.url: r.verdict for r in rows} == urls
    weights = list(model.weights)
    for r in rows[:6]:  # the probability, by hand, over the n-grams' places
        at = spark.createDataFrame([(r.host, r.path)], "host string, path string").select(url_filter.places()).first()[0]
        z = model.intercept + sum(weights[i] for i in at) / max(len(at), 1)
        assert abs(r.p_block - 1 / (1 + math.exp(-z))) < 1e-9


def page(body, head="<title>Title</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{}}</style></head><body>{body}</body></html>"


ONE = "Water &amp; light run <b>through</b> the old town,   and the people of the town are glad of it every day of the year."
TWO = "In the evening the meters are read again, and the numbers are written down in a book that is kept in the hall."
WANT = "Water & light run through the old town, and the people of the town are glad of it every day of the year."
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
LINKS = '<div class="list">' + "".join(f'<p><a href="/{i}">A link to some other page number {i}</a></p>' for i in range(12)) + "</div>"


@pytest.mark.parametrize("html, want", [
    (page(f"{NAV}<article><h1>Head</h1><p>{ONE}</p><p>{TWO}</p><p>Short.</p></article><footer>End</footer>"), f"Head {WANT} {TWO} Short."),
    (page(f"{NAV}<div id=x><p>{ONE}<br>{TWO}</p><p>{TWO}</p><p>{ONE}</p></div>{LINKS}"), f"{WANT} {TWO} {TWO} {WANT}"),
    (page(f"<article><p>{ONE}</p><div class='comments'><p>{TWO}</p></div><form><p>{TWO}</p></form></article>"), WANT),
    (page(f"<article><p>{ONE}<aside>{TWO}</aside><div class='ad'>{TWO}</div><script>var x='</p>';</script></article>"), WANT),
    (page(f"<div class='page-with-sidebar'><main><p>{ONE}</p></main><div id='sidebar'><p>{TWO}</p></div></div>"), WANT),
    (page(f"<article><p><b>{TWO}<br><p>{ONE}</article>"), f"{TWO} {WANT}"),
    (page(f"<article><p>{ONE}</p><p>{TWO}")[:-14], f"{WANT} {TWO}"),
    (page(f"<div class=a><div class=b><p>{ONE}</p><p>{TWO}</p><p>{ONE}</p></div><div class=c><p>{TWO}</p><p>{ONE}</p></div></div>"),
     f"{WANT} {TWO} {WANT} {TWO} {WANT}"),
    (page("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul></article>"), "a b c x y"),
    (page(f"<article><p>a&nbsp;&lt;b&gt;\n\t c&#233;</p><!-- {TWO} --><![CDATA[x]]></article>"), "a <b> cé"),
    (page(NAV), ""), ("plain words only", "plain words only"), ("", ""), (None, ""), ("<", "<"), ("</p></div><p>x", "x"),
])
def test_main_text(html, want):
    assert html_density.extract(html) == want


TEASER = f'<article class="card"><a href="/x"><h3>Another page</h3></a><p>{ONE}</p></article>'
PART = f"<p>{ONE}</p><p>{TWO}</p>"


@pytest.mark.parametrize("html, want", [
    (page(f"{NAV}<article>{PART * 2}</article><article>{PART}</article>"), " ".join([WANT, TWO] * 3)),
    (page(f"<div><article><h2>One</h2>{PART}</article><article><h2>Two</h2><p>{TWO}</p></article></div><p>Call us</p>"),
     f"One {WANT} {TWO} Two {TWO}"),
    (page(f"<main><p>{ONE}</p>{PART * 3}</main>{TEASER}"), f"{WANT} " + " ".join([WANT, TWO] * 3)),
    (page(f"<div id=x>{PART * 3}</div><div>{TEASER}</div>"), " ".join([WANT, TWO] * 3)),
    (page(f"<article><h1>Head</h1><div>{PART * 2}</div></article>"), "Head " + " ".join([WANT, TWO] * 2)),
    (page(f"<article><div>{PART * 2}</div>{LINKS}</article>"), " ".join([WANT, TWO] * 2)),
])
def test_density_decides_beside_and_inside_landmarks(html, want):
    assert html_density.extract(html) == want


BODY, ALL = f"<p>{ONE}</p><p>{TWO}</p>" * 3, " ".join([WANT, TWO] * 3)


@pytest.mark.parametrize("html, want", [
    (page(f"<div class='content has-sidebar'>{BODY}</div><p>Call us</p>"), ALL),
    (page(f"<div class='post comments-open'>{BODY}</div><p>Call us</p>"), ALL),
    (page(f"<div class='social'>{BODY}</div><p>Call us</p>"), ALL),
    (page(f"<div id='notice'>{BODY}</div>"), ALL),
    (page(f"<div class='legal'><p>{ONE}</p></div><div class='notice'><p>{TWO}</p></div>"), f"{WANT} {TWO}"),
    (page(f"<form><div>{BODY}</div><input name=x><select><option>One</select></form>"), ALL),
    (page(f"<article>{BODY}<section id='related-work'><p>{ONE}</p></section><div class='legal-history'><p>{TWO}</p></div></article>"),
     f"{ALL} {WANT} {TWO}"),
    (page(f"<article>{BODY}<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p></article>"), f"{ALL} Let x=1 hold."),
    (page(f"<div class=x>{BODY}</div><div class='comments'>{''.join(f'<div class=comment>{BODY}</div>' for _ in range(9))}</div>"), ALL),
    (page(f"<div class=x>{BODY}</div><div class='sidebar-inner'><p>{ONE}</p></div><div class='cookieNotice'><p>{TWO}</p></div>"), ALL),
    (page(f"<div class=x>{BODY}</div><div class='widget'>{LINKS * 4}</div>"), ALL),
    (page(f"<div class='ad'>{TWO}</div><article><p>One word.</p></article>"), "One word."),
])
def test_names_do_not_take_the_text(html, want):
    assert html_density.extract(html) == want


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + ONE + "</div>" * 20_000
    assert html_density.extract(deep) == WANT
    long = page("<article>" + f"<p>{ONE}</p>" * 20_000 + "</article>")
    assert html_density.extract(long) == " ".join([WANT] * 20_000)


def test_density_prefers_text_over_links():
    assert html_density.density(100, 2, 0, 0, 0.1) > html_density.density(100, 2, 90, 2, 0.1)
    assert html_density.density(100, 2, 0, 0, 0.1) > html_density.density(100, 20, 0, 0, 0.1)
    assert html_density.density(0, 3, 0, 0, 0.0) == 0


def test_main_text_frame(spark, pages):
    out = html_density.main_text(pages.withColumn("text", F.lit("old")))
    assert set(out.columns) == {"page_id", "url", "digest", "text", "n_chars"} and out.count() == len(PAGES)
    rows = {r.page_id: r for r in out.collect()}
    assert rows[3].text == rows[4].text == "" and rows[9].n_chars == 3_000_000 and rows[9].digest == "mine"
    assert html_density.main_text(pages.limit(0)).count() == 0
