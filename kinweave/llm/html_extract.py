"""Main text of web pages by line-block distribution.

The markup is stripped into lines, one a block element. A line's *size* is its characters outside links, times a weight
that the markup hints at; the sizes of ``window`` neighbouring lines, centred on each line, are summed. Text surges where
that sum rises above a threshold and dives where it falls back; the lines between a surge and its dive are the text. The
threshold is ``floor``, or three tenths of the largest sum on pages with less text; it does not grow with the longest line.

Weights. Elements whose tag, role, class or id names a menu, header, footer, sidebar, notice, advert, form or reader
comments are *hinted*: their lines weigh nought, or a tenth where the name is loose (``share``, ``widget``). A hint is void if its
element holds over half of the page's text: it is a wrapper then, whatever its name; so no text goes by a name alone (``nav``, ``footer``,
``aside`` and names of reader comments are void only if they hold over half of the page's ``article`` or ``main``). ``article`` and ``main`` count if
they hold a third of the unhinted text: lines outside them weigh a tenth, lines inside an ``article`` eight times as much, so that
short paragraphs and lists there stay while teasers elsewhere go.

Between surge and dive these lines go too: hinted or outside ones that do not pass the threshold alone, runs of lines that are mostly
links, lines of links at either end outside an article, and short lines at either end that continue a run of short lines beyond it. Headings that stand right before a surge
belong to it. Gaps of short lines between two surges of one container are bridged.

Edge cases: null or empty html: empty text. Unclosed tags, comments and character references: read as browsers do, to
the end of the enclosing element. White space, U+00A0 and Unicode's other spaces included, becomes one space. Repeated rows: each
extracted. Null ids and urls pass through. Extra columns of any name are ignored. Empty table: no rows. Time is linear in the
length of a page, however deep its elements are nested.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import batch

WINDOW = 3
FLOOR = 40
#: Weight of lines in an ``article``, outside the article or main, and under a loose hint.
ARTICLE, OUTSIDE, LOOSE = 8.0, 0.1, 0.1

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object"}
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in _RAW}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_DROP = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "fieldset", "audio", "video", "canvas"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_INLINE = {"b", "i", "em", "strong", "a", "span", "u", "font"}
_BLOCK = {
    "p", "div", "li", "ul", "ol", "dl", "dt", "dd", "table", "tr", "caption", "thead", "tbody", "tfoot", "blockquote",
    "pre", "section", "article", "main", "header", "figure", "figcaption", "address", "details", "summary", "center", "body", "html", "hr", "hgroup",
} | _DROP | _HEADINGS
_FIRM_TAGS = {"nav", "footer", "aside"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "menu", "menubar", "form"}
_COMMENTS = {"comment", "comments", "respond", "disqus", "reply", "replies"}
_FIRM = {
    "nav", "navbar", "navigation", "menu", "menubar", "masthead", "topbar", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "adsense",
    "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "breadcrumb", "breadcrumbs", "newsletter", "subscribe", "subscription",
    "signup", "login", "pagination", "pager",
} | _COMMENTS
_LOOSE = {"header", "banner", "notice", "alert", "promo", "promotion", "share", "sharing", "social", "search", "related", "recommended", "widget", "toolbar", "copyright", "skip"}
#: Words that may name a part of the article itself when inside it.
_INNER = {"header", "banner", "copyright", "search"}
#: Names that say what a page has, or name a wrapper, hint at less or nothing.
_NOT = {"has", "with", "no", "not", "without", "is"}
_WRAPPERS = {"page", "layout", "wrapper", "wrap", "container", "template", "enabled", "disabled", "open", "closed"}


class Line(NamedTuple):
    text: str
    linked: int  # characters inside links
    heading: bool
    article: bool
    main: bool
    hint: int  # the innermost hinted element, -1 if none


class Hint(NamedTuple):
    parent: int
    weight: float
    firm: bool  # not void by its share of a page without article


def _hint(tag: str, attrs: str, inside: bool) -> tuple[float, bool, bool] | None:
    """(weight, whether it stands by its meaning, whether it names reader comments) of an element that the markup hints at as no text."""
    if tag in _DROP or (tag == "header" and not inside):
        return 0.0, tag in _FIRM_TAGS, False
    if tag in ("html", "body") or not attrs or ("=" not in attrs and "hidden" not in attrs):
        return None
    best = None
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in _ROLES):
            return 0.0, False, False
        if name not in ("class", "id"):
            continue
        for one in value.split():
            words = [w.lower() for w in _SPLIT.split(one) if w]
            if not words or words[0] in _NOT:
                continue
            found = set(words) & (_FIRM | _LOOSE)
            if inside:
                found -= _INNER
            if found:
                firm = bool(found & _FIRM) and words[-1] not in _WRAPPERS
                comments = firm and bool(found & _COMMENTS)
                mine = (0.0 if firm else LOOSE, comments, comments)
                best = mine if best is None else (min(best[0], mine[0]), best[1] or mine[1], best[2] or mine[2])
    return best


def lines_of(html: str) -> tuple[list[Line], list[Hint]]:
    lines: list[Line] = []
    hints: list[Hint] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, int, bool]] = []  # tag, hint that it opens or -1, whether it bars
    count: Counter[str] = Counter()
    current = -1
    barred = 0  # open elements within which an article is none of the page's own
    article = main = 0
    heading = False

    def end_line() -> None:
        nonlocal parts, linked, heading
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                lines.append(Line(text, min(linked, len(text)), heading, article > 0, main > 0, current))
        parts, linked, heading = [], 0, False

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = entities.unescape(text) if "&" in text else text
            parts.append(text)
            if count["a"]:
                linked += len(text.strip())

    def close() -> str:
        nonlocal current, barred, article, main
        tag, opened, bars = stack.pop()
        count[tag] -= 1
        if tag in _BLOCK or tag == "article!" or opened >= 0:
            end_line()
        if opened >= 0:
            current = hints[opened].parent
        barred -= bars
        if tag == "article!":
            article -= 1
        elif tag == "main":
            main -= 1
        return tag

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            continue
        closing, attrs = (m.group(1), m.group(3)) if m.group(2) else (m.group(4), m.group(6))
        tag = tag.lower()
        if not closing:
            if tag in _RAW:
                if not attrs.endswith("/"):
                    end = _RAW_END[tag].search(html, at)
                    at = end.end() if end else n
                continue
            if tag in _VOID:
                if tag == "hr":
                    end_line()
                else:
                    add(" ")
                continue
            if tag in _BLOCK:
                end_line()
                if tag in ("p", "li", "tr", "dt", "dd") and count[tag]:  # an open one ends here
                    while stack and (stack[-1][0] in _INLINE or stack[-1][0] == tag):
                        if close() == tag:
                            break
            elif tag in ("td", "th"):
                add(" ")
            found = _hint(tag, attrs, article + main > 0)
            opened = -1
            if found is not None:
                end_line()
                opened = len(hints)
                hints.append(Hint(current, found[0], found[1]))
                current = opened
            bars = tag in _FIRM_TAGS or (found is not None and found[2])
            barred += bars
            if tag == "article":
                if not barred:
                    tag = "article!"
                    article += 1
            elif tag == "main":
                main += 1
            stack.append((tag, opened, bars))
            count[tag] += 1
            heading = heading or tag in _HEADINGS
            continue
        if tag == "article" and count["article!"]:
            tag = "article!" if not count["article"] or next(t for t, *_ in reversed(stack) if t.startswith("article")) == "article!" else tag
        if not count[tag]:
            if tag in _BLOCK:
                end_line()
            continue
        while stack:
            if close() == tag:
                break
    while stack:
        close()
    end_line()
    return lines, hints


def sizes(lines: list[Line], hints: list[Hint]) -> tuple[list[float], list[float]]:
    """(weighted sizes, weights) of the lines."""
    own = [max(len(line.text) - line.linked, 0) for line in lines]
    under = [0] * len(hints)  # characters of each hinted element
    within = [0] * len(hints)  # those in an article or main
    inner = 0
    for line, size in zip(lines, own):
        if line.hint >= 0:
            under[line.hint] += size
            within[line.hint] += size * (line.article or line.main)
        inner += size * (line.article or line.main)
    for k in range(len(hints) - 1, -1, -1):  # children come after their parents
        if hints[k].parent >= 0:
            under[hints[k].parent] += under[k]
            within[hints[k].parent] += within[k]
    total = sum(own)

    def weights(whole: int, part: list[int], marked: bool) -> list[float]:
        out: list[float] = []
        for k, h in enumerate(hints):
            void = part[k] * 2 > whole and (marked or not h.firm)
            out.append((out[h.parent] if h.parent >= 0 else 1.0) * (1.0 if void else h.weight))
        return out

    by_all = weights(total, under, False)
    plain = sum(size for line, size in zip(lines, own) if line.hint < 0 or by_all[line.hint] > LOOSE / 2)
    marked = inner > 0 and inner * 3 >= plain
    hinted = weights(inner, within, True) if marked else by_all
    weight = []
    for line in lines:
        w = hinted[line.hint] if line.hint >= 0 else 1.0
        if marked:
            w *= ARTICLE if line.article else 1.0 if line.main else OUTSIDE
        weight.append(w)
    return [s * w for s, w in zip(own, weight)], weight


def blocks(lines: list[Line], size: list[float], weight: list[float], window: int = WINDOW, floor: float = FLOOR) -> list[bool]:
    """Which lines are text."""
    n = len(lines)
    before = [0.0]
    for s in size:
        before.append(before[-1] + s)
    back = window // 2
    sums = [before[min(max(i - back + window, 0), n)] - before[max(i - back, 0)] for i in range(n)]
    limit = min(floor, 0.3 * max(sums, default=0.0))
    inside = [s > limit + 1e-9 for s in sums]  # between a surge and its dive
    short = [0 < s <= limit / 2 and not line.heading and w > OUTSIDE for s, w, line in zip(size, weight, lines)]
    links = [line.linked * 2 > len(line.text) for line in lines]
    # gaps of short lines between two surges of one container
    i = 0
    while i < n:
        if inside[i]:
            i += 1
            continue
        j = i
        while j < n and not inside[j]:
            j += 1
        if 0 < i and j < n and all(weight[k] == weight[i - 1] == weight[j] and not links[k] for k in range(i, j)):
            inside[i:j] = [True] * (j - i)
        i = j
    keep = list(inside)
    i = 0
    while i < n:
        if not inside[i]:
            i += 1
            continue
        j = i
        while j < n and inside[j]:
            j += 1
        a, b = i, j
        while a < b and links[a] and weight[a] <= 1:
            keep[a] = False
            a += 1
        while a < b and links[b - 1] and weight[b - 1] <= 1:
            keep[b - 1] = False
            b -= 1
        while a < b and short[a] and a >= 2 and short[a - 1] and short[a - 2]:
            keep[a] = False
            a += 1
        while a < b and short[b - 1] and b + 1 < n and short[b] and short[b + 1]:
            keep[b - 1] = False
            b -= 1
        k = i - 1
        while k >= 0 and lines[k].heading and weight[k] >= weight[i] and not links[k] and not keep[k]:
            keep[k] = True
            k -= 1
        i = j
    top = max((w for w, k in zip(weight, inside) if k), default=0.0)
    for i in range(n):
        if keep[i] and weight[i] < min(top, 1.0) and size[i] <= limit:
            keep[i] = False  # hinted or outside, and not enough alone
        if keep[i] and links[i] and ((i and links[i - 1]) or (i + 1 < n and links[i + 1]) or weight[i] < min(top, 1.0)):
            keep[i] = False
    return keep


def extract(html: str | None, window: int = WINDOW, floor: float = FLOOR) -> tuple[str, int, int]:
    """(text, lines, kept lines)."""
    if not html:
        return "", 0, 0
    lines, hints = lines_of(html)
    size, weight = sizes(lines, hints)
    kept = [line.text for line, k in zip(lines, blocks(lines, size, weight, window, floor)) if k]
    return "\n\n".join(kept), len(lines), len(kept)


def _extract(window: int, floor: float):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_lines", pa.int64()), ("n_kept", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = [extract(h.as_py(), window, floor) for h in part.column(2)]
                yield batch(schema, page_id=part.column(0), url=part.column(1), text=[f[0] for f in found], n_chars=[len(f[0]) for f in found], n_lines=[f[1] for f in found], n_kept=[f[2] for f in found])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, floor: float = FLOOR) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_kept for every row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract(window, floor), "page_id long, url string, text string, n_chars long, n_lines long, n_kept long")
