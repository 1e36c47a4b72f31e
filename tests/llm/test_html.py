"""Line-block distribution on generated pages, odd pages, and in Spark."""

import random
import re
import time
from html import unescape

import pytest

from kinweave.llm import html_extract
from tests.llm.fixtures import collected
from tests.llm.test_pages import PAGE

WRAPPERS = ("", "content", "layout has-sidebar", "widget-area-page", "search-results-page", "sidebar-layout")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(n)) + "."


def planted(seed, tag):
    """(page, blocks of its article): menus, adverts, notices, comments and a footer around it."""
    rng = random.Random(seed)
    parts = [("h1", sentence(rng, 5))] + [("p", sentence(rng, rng.randrange(20, 60))) for _ in range(rng.randrange(3, 9))]
    parts.insert(2, ("li", sentence(rng, 12)))
    if seed % 3 == 0:
        parts.insert(3, ("p", sentence(rng, 3000)))
    parts.append(("p", sentence(rng, 4)))
    body = "".join(f"<{t}>{x if t != 'p' else x.replace(' ', rng.choice([' ', chr(10) + ' ', ' <b>x</b> ', '<br>']), 1)}</{t}>" + ("<div class='ad-slot'>buy it now</div>" if k == 2 else "") for k, (t, x) in enumerate(parts))
    want = [" ".join(unescape(re.sub("<[^>]*>", " ", m.group(1))).split()) for m in re.finditer(r"<(?:h1|p|li)>(.*?)</(?:h1|p|li)>", body, re.S)]
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>{sentence(rng, 2)}</a></li>" for k in range(6)) + "</ul>"
    comments = "<section class='comments'><h3>Comments</h3>" + "".join(f"<article class='comment'><p>{sentence(rng, 30)}</p></article>" for _ in range(rng.randrange(3))) + "</section>"
    article = f"<{tag}>{body}</{tag}>" if tag else f"<div>{body}</div>"
    inner = f"<div>{menu}</div><div class='cookie-notice'>{sentence(rng, 25)}</div>{article}{comments}<aside><p>{sentence(rng, 20)}</p></aside>"
    name = WRAPPERS[seed % len(WRAPPERS)]
    return f"<html><head><title>t</title></head><body><nav>{menu}</nav><div class='{name}'>{inner}</div><footer>&copy; {sentence(rng, 15)}</footer></body></html>", want


@pytest.mark.parametrize("tag", ["article", "main", ""])
def test_planted_articles(tag):
    hit = found = wanted = 0
    for seed in range(60):
        html, want = planted(seed, tag)
        got = html_extract.extract(html)[0].split("\n\n")
        hit += sum(len(x) for x in got if x in want)
        found += sum(map(len, got))
        wanted += sum(map(len, want))
    assert hit / wanted > 0.995 and hit / found > 0.995


def plain_blocks(texts, window, floor):
    """The distribution spelled out, for lines without markup: sums, surges and dives."""
    size = [len(t) for t in texts]
    back = window // 2
    sums = [sum(size[k] for k in range(i - back, i - back + window) if 0 <= k < len(size)) for i in range(len(size))]
    limit = min(floor, 0.3 * max(sums))
    return [s > limit for s in sums], [0 < s <= limit / 2 for s in size]


@pytest.mark.parametrize("window", [1, 3, 5])
def test_windows_and_threshold_against_brute_force(window):
    rng = random.Random(window)
    for _ in range(200):
        texts = ["x" * rng.choice([3, 10, 15, 30, 60, 400]) for _ in range(rng.randrange(1, 25))]
        inside, short = plain_blocks(texts, window, 60)
        for i in range(1, len(texts)):  # gaps between two surges are bridged
            if inside[i - 1] and not inside[i] and any(inside[i:]):
                inside[i] = True
        keep = list(inside)
        first, last = (inside.index(True), len(texts) - 1 - inside[::-1].index(True))
        a, b = first, last
        while a <= b and short[a] and a >= 2 and short[a - 1] and short[a - 2]:
            keep[a], a = False, a + 1
        while a <= b and short[b] and b + 2 < len(texts) and short[b + 1] and short[b + 2]:
            keep[b], b = False, b - 1
        html = "".join(f"<div>{t}</div>" for t in texts)
        assert html_extract.extract(html, window, 60)[0] == "\n\n".join(t for t, k in zip(texts, keep) if k)


def test_parameters_decide_inside_articles_too():
    pages = [planted(seed, "article")[0] for seed in range(20)]
    texts = [[html_extract.extract(p, w, f)[0] for p in pages] for w, f in ((3, 40), (1, 100_000), (3, 100_000))]
    assert texts[0] != texts[1] and texts[1] != texts[2] and texts[0] != texts[2]


def test_wrappers_menus_and_teasers():
    words = "word " * 80
    for name in WRAPPERS + ("sidebar",):
        assert html_extract.extract(f'<div class="{name}"><p>{words}</p></div>')[0] == words.strip()
    assert html_extract.extract(f"<main><ul><li><a>Home</a><li><a>About</a></ul>{''.join(f'<div>menu item {k}</div>' for k in range(5))}<h1>T</h1><p>{words}</p></main>")[0] == "T\n\n" + words.strip()
    page = f'<article class="card"><p>teaser text of forty characters or so here</p></article><div>{"<p>" + words + "</p>"}{"<p>" + words + "</p>"}</div>'
    assert html_extract.extract(page)[0].endswith("\n\n".join([words.strip()] * 2))


def test_deep_nesting_is_linear():
    began = time.time()
    html_extract.extract("<div>" * 100_000 + "</p>" * 100_000 + "x")
    assert time.time() - began < 5


def test_main_text_in_spark(spark):
    rows = [(1, "u", PAGE, "x", "y", 1), (1, "u", PAGE, "x", "y", 1), (2, None, None, None, None, None), (3, "u", "", "", "", 2), (None, None, "<p>no id", None, None, 3), (4, "u", "<p>" + "long text " * 300_000, "t", "l", 4)]
    rows += [(10 + seed, "u", planted(seed, ("article", "main", "")[seed % 3])[0], "t", "l", 5) for seed in range(30)]
    schema = "page_id long, url string, html string, text string, lines string, n_chars int"
    got = collected(html_extract.main_text(spark.createDataFrame(rows, schema)))
    assert len(got) == len(rows) and {tuple(g) for g in got} == {("page_id", "url", "text", "n_chars", "n_lines", "n_kept")}
    want = sorted(((r[0] is None, r[0] or 0, r[1] or "", *html_extract.extract(r[2])) for r in rows))
    assert sorted((g["page_id"] is None, g["page_id"] or 0, g["url"] or "", g["text"], g["n_lines"], g["n_kept"]) for g in got) == want
    assert all(g["n_chars"] == len(g["text"]) for g in got) and [g["text"] for g in got if g["page_id"] in (2, 3)] == ["", ""]
    assert html_extract.main_text(spark.createDataFrame([], schema)).count() == 0


def test_registered_query(spark):
    """Pages of the given tables hold their text in one article whose blocks are p and h1: an independent reading of these."""
    from kinweave.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    html = {r["page_id"]: r["html"] for r in collected(spark.read.parquet(f"{folder}/pages.parquet"))}
    for g in collected(QUERIES["op3_html_extraction"](spark, folder)):
        inner = re.search(r"<article>(.*?)</article>", html[g["page_id"]], re.S)
        parts = re.split(r"</?(?:p|h1|h2|h3|ul|li|div|blockquote|table|tr|pre|section)\b[^>]*>", re.sub(r"<!--.*?-->", "", inner.group(1), flags=re.S))
        plain = [" ".join(unescape(re.sub(r"<br/?>", " ", re.sub(r"</?(?:b|i|em|strong|a|span)\b[^>]*>", "", p))).split()) for p in parts]
        assert g["text"] == "\n\n".join(p for p in plain if p)
