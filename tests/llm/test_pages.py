"""Operators over pages."""

import base64
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinweave.llm import html_extract, url_filter, warc
from tests.llm.fixtures import collected

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></ul></nav><div id="cookie-notice">We use cookies</div><aside><p>Side text that is quite long really</p></aside>
<main><article class="post"><header><h2>Title &amp; more</h2></header><p>Hello <b>bold</b>
 world&nbsp;&lt;x&gt;</p><div class="ad-slot">buy</div><p title="a > b">Second<br>line<p>Third <a href='x'>link</a>.
<form><input><label>q</label></form><ul><li>one<li>two</ul><table><tr><td>a</td><td>b</td></tr></table></article>
<section class="comments"><h3>Comments</h3><article class="comment"><p>nice</p></article></section></main>
<script>if(a<b){document.write("<p>x</p></article>")}</script><footer>foot &copy;</footer></body>"""


def test_article():
    text, *_ = html_extract.extract(PAGE)
    assert text == "Title & more\n\nHello bold world <x>\n\nSecond line\n\nThird link.\n\none\n\ntwo\n\na b"


def test_without_article():
    body = "<h1>My title</h1><p>" + "word " * 40 + "</p><p>short.</p><p>" + "word " * 30 + "</p>"
    page = f"<div><a href=1>Home</a> <a href=2>About us</a></div><div class=content>{body}</div><div><a>More</a></div><div><a>x</a></div><div><a>y</a></div><div>(c) 2020</div>"
    assert html_extract.extract(page)[0] == "My title\n\n" + " ".join(["word"] * 40) + "\n\nshort.\n\n" + " ".join(["word"] * 30)


def test_long_block_among_short_paragraphs():
    parts = ["word " * 40, "long " * 4000, *["some text " * 20] * 6, "The end."]
    page = "<div><a>Home</a></div><div>" + "".join(f"<p>{x}</p>" for x in parts) + "</div><div><a>More</a></div><div><a>x</a></div><div>(c) 2020</div>"
    assert html_extract.extract(page)[0] == "\n\n".join(x.strip() for x in parts)


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a", "a"), ("<!-- x", ""), ("<div ", ""), ("a < b <p>c > d", "a < b\n\nc > d"), ("<article><p>x &am", "x &am"), ("<script>never closed <p>x", "")])
def test_odd_html(html, text):
    assert html_extract.extract(html)[0] == text


def pages(spark, empty=False):
    rows = [(i, f"https://WWW.Ex{i % 3}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'de', 'es')[i % 3]}/{i}?q=/x#f", f"<article><p>page {i % 7}</article>", "x") for i in range(40)]
    rows += [(100, None, None, None), (101, "no scheme/en/", "", None), (102, "http://com/en/", "", None), (103, "x://example.com:80/en/7", "a" * 3_000_000, None), (104, "http://ads.EXAMPLE.com", PAGE, None), (105, "http://a.example.com/en/77#://net/de/", "é", None), (None, "http://notcom/en/", "<p>null id", None), rows[3]]
    return spark.createDataFrame([] if empty else rows, "page_id long, url string, html string, text string")


def judged(url):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "block" if host in url_filter.LISTED_HOSTS else "allow"))
    return host, path, rule, verdict


def test_url_filter(spark):
    rows = collected(pages(spark))
    got = Counter((g["page_id"], g["host"], g["path"], g["rule"], g["verdict"]) for g in collected(url_filter.judge(pages(spark))))
    assert got == Counter((r["page_id"], *judged(r["url"])) for r in rows)
    assert url_filter.judge(pages(spark, True)).count() == 0


@pytest.mark.parametrize("max_bytes", [8 << 20, 64])  # a cascade, and what is done where a level would be too large
def test_thousands_of_listed_hosts(spark, max_bytes):
    import random

    rng = random.Random(6)
    name = lambda: f"h{rng.randrange(9000)}.{rng.choice(['example', 'site'])}.{rng.choice(['com', 'io', 'org'])}"
    rows = [(i, f"https://{name()}/{rng.choice(['en', 'x', ''])}/{i}", "h", "k", 1.0, "b") for i in range(6000)] + [(None, None, None, None, None, None), (7, "no scheme", "", "", 0.0, "")]
    listed = {name() for _ in range(4000)}
    docs = spark.createDataFrame(rows, "page_id long, url string, host string, key string, best double, listed string")
    table = spark.createDataFrame([(h, 1) for h in listed] + [(None, 2), (min(listed), 3)], "host string, listed int")
    rules = url_filter.RULES if max_bytes > 64 else url_filter.RULES[:1]
    got = collected(url_filter.judge(docs, rules=rules, listed_hosts=table, max_bytes=max_bytes))
    want = Counter((r[0], h := judged(r[1])[0], h in listed) for r in rows)
    assert Counter((g["page_id"], g["host"], g["listed"]) for g in got) == want and sum(g["listed"] for g in got) > 300
    assert all(g["verdict"] == "block" for g in got if g["listed"] and g["rule"] is None) and all(g["verdict"] == "allow" for g in got if not g["listed"] and g["rule"] is None)


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("hash(key) % 5 = 0")
    cascade = url_filter.build_cascade(listed, universe)
    assert len(cascade.levels) > 2
    assert universe.where(cascade.contains(F.col("key"))).exceptAll(listed).count() == 0 and listed.where(~cascade.contains(F.col("key"))).count() == 0
    with pytest.raises(ValueError):
        url_filter.build_cascade(listed, universe, max_bytes=16)


def test_warc_round_trip(spark):
    rows = collected(pages(spark))
    top = {}
    for r in rows:
        if r["page_id"] is not None:
            top[r["html"] or ""] = max(top.get(r["html"] or "", -1), r["page_id"])
    want = Counter()
    for r in rows:
        payload = (r["html"] or "").encode()
        first = top.get(r["html"] or "")
        response = r["page_id"] == first or first is None
        want[(r["page_id"], len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if response else "revisit", None if response else first)] += 1
    got = Counter((g["page_id"], g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) for g in collected(warc.round_trip(pages(spark))))
    assert got == want
    assert warc.round_trip(pages(spark, True)).count() == 0


def test_clashing_columns(spark):
    names = ("host", "key", "best", "bytes", "sha", "rule", "listed", "response", "first", "n", "text", "path", "kept", "name", "content")
    docs = pages(spark).drop("text")
    wide = docs
    for k, name in enumerate(names):
        wide = wide.withColumn(name, F.lit(f"c{k}"))
    for f in (url_filter.judge, warc.round_trip, html_extract.main_text):
        assert Counter(map(str, collected(f(wide)))) == Counter(map(str, collected(f(docs))))


def test_warc_texts_and_limits(spark):
    path = warc.shared_path(spark, "t")
    warc.write_archives(pages(spark), path, min_bytes=10, archive_bytes=2000)
    back = collected(warc.read_archives(spark, path))
    html = {r["page_id"]: r["html"] or "" for r in collected(pages(spark))}
    assert all(b["html"] == html[b["page_id"]] for b in back if b["record_type"] == "response") and all(b["record_type"] == "response" for b in back if b["payload_bytes"] < 10)


def test_warc_faults():
    payloads = [f"<p>page number {i} with some common words in it</p>".encode() * 20 for i in range(40)]
    records = [warc.record(i, f"http://x/{i}", p, True, None) for i, p in enumerate(payloads)]
    dictionary = warc.train(payloads)
    assert dictionary is not None
    data = warc.archive(records, dictionary)
    assert data[:4] == warc.MAGIC and [b.partition(b"\r\n\r\n")[2] for _, _, b in warc.records_of(data)] == payloads
    assert len(list(warc.records_of(warc.archive(records, None)))) == 40
    broken = bytearray(data)
    broken[-20] ^= 255
    for bad in (data[:-3], bytes(broken), data + b"junk", data[:100]):
        with pytest.raises(ValueError):
            list(warc.records_of(bad))
    for cut in (1, 3, 4, 5, 6, 9, len(data) - 1):  # truncated anywhere, the magic alone included
        with pytest.raises(ValueError):
            list(warc.records_of(warc.FRAME[:cut] if cut <= 4 else data[: len(data) - cut]))
    with pytest.raises(ValueError):
        list(warc.records_of(warc.FRAME))
    good = records[0]
    for bad in (good[:-4], good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"Content-Length: ", b"Content-Length: 9")):
        with pytest.raises(ValueError):
            warc.parse(bad)
