"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element.  Text in menus,
headers, forms, adverts and the like gives a window of empty lines, and link text
carries no length.  A line weighs its length, and more in an article element.  Weights
are summed over windows of ``WINDOW`` lines; text starts where the sum surges over a
threshold that follows the page's largest window, and ends where it dives to
nothing.  What lies between a surge and its dive is kept, short lines included.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import bounded_batches

WINDOW, SURGE, SURGE_SHARE = 3, 50, 0.25

# Element names of HTML, and words of class, id and role that name what is not the article.
RAW = frozenset({"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "canvas", "object", "head", "xmp"})
APART = frozenset({"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset"})
BLOCKS = frozenset({
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
CONTAINERS = frozenset({"article", "main"})
BOILERPLATE = frozenset({
    "ad", "ads", "advert", "adverts", "advertisement", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "consent", "contentinfo", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "header", "legal", "login", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo",
    "promoted", "recommended", "related", "reply", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget",
})

#: Elements that hold running text: their ids are anchors and say nothing about what they are.
TEXTUAL = frozenset({"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "td", "th", "figcaption", "caption"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _is_apart(name: str, attributes: str) -> bool:
    if name in APART:
        return True
    if not attributes or name in ("body", "html"):
        return False
    told = [v for k, v in _ATTRIBUTE.findall(attributes) if k.lower() in ("class", "role") or k.lower() == "id" and name not in TEXTUAL]
    return any(w in BOILERPLATE for v in told for w in _WORD.findall(_CAMEL.sub(" ", v).lower()))


def _tags(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of the tags in order; comments and the like have no name, and an element of raw text is one tag without a name up to its end."""
    out, at = [], 0
    while m := _TAG.search(page, at):
        name, closing, attributes = (m[2] or m[5] or "").lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        at = m.end()
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
                out.append((m.start(), at, "", False, name))
            continue
        out.append((m.start(), at, name, closing, attributes))
    return out


def _ends(tags: list[tuple[int, int, str, bool, str]]) -> dict[int, int]:
    """For every opening tag that has one, the number of its closing tag: one pass with a stack; what an outer end finds still open has none."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}
    for k, (_, _, name, closing, attributes) in enumerate(tags):
        if not name or name in VOID or attributes.endswith("/"):
            continue
        if not closing:
            stack.append((name, k))
            held[name] = held.get(name, 0) + 1
        elif held.get(name):
            while True:
                n, j = stack.pop()
                held[n] -= 1
                if n == name:
                    ends[j] = k
                    break
    return ends


def lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, length that isn't link text, whether in an article element) of each block in page order; what stands apart is a window of empty lines."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = inside = anchor = heading = 0

    def close_block() -> None:
        nonlocal parts, linked, heading
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, len(text) if heading else max(0, len(text) - linked), inside > 0))
        parts, linked, heading = [], 0, 0

    tags = _tags(page)
    ends = _ends(tags)
    at = k = 0
    while True:
        start = tags[k][0] if k < len(tags) else len(page)
        text = page[at:start]
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(text) * (anchor > 0)
        if k == len(tags):
            break
        _, at, name, closing, attributes = tags[k]
        if not closing and k in ends and _is_apart(name, attributes):
            close_block()
            out += [("", 0, False)] * WINDOW
            k = ends[k]
            at = tags[k][1]
        elif not name:
            if attributes == "head":
                close_block()
        else:
            if name in BLOCKS:
                close_block()
                heading = int(name in HEADINGS and not closing)
            elif name in ("br", "td", "th"):
                parts.append(" ")
            if name in CONTAINERS:
                inside = max(0, inside + (-1 if closing else 1))
            elif name == "a":
                anchor = 0 if closing else 1
        k += 1
    close_block()
    return out


def weights(found: list[tuple[str, int, bool]]) -> np.ndarray:
    """Weight of each line: its length without link text, and markup as a weight beside it.

    Where a page marks its article, a line in it that isn't link text alone weighs ``SURGE`` more, and lines elsewhere weigh nothing.
    """
    contained = any(inside for _, _, inside in found)
    return np.array([(length + SURGE * (length > 0)) * inside if contained else length for _, length, inside in found], dtype=np.int64)


def main_text(page: str | None) -> str:
    """The kept blocks, joined by one line feed; empty for a null or empty page.

    Text starts where a window's sum surges over the threshold and ends where it dives to nothing: so runs of at
    least ``WINDOW`` lines of link text are left out, in an article element too, and shorter ones beside text stay there.
    """
    found = lines(page) if page else []
    size = weights(found)
    if not size.any():
        return ""
    padded = np.concatenate((size, np.zeros(WINDOW, dtype=np.int64)))
    window = np.convolve(padded, np.ones(WINDOW, dtype=np.int64), mode="valid")  # window[i] sums lines i to i + WINDOW - 1
    surge = min(SURGE, SURGE_SHARE * window.max())
    contained = any(inside for _, _, inside in found)
    kept: list[str] = []
    i = 0
    while i < len(found):
        if window[i] < surge or not size[i] and not found[i][2]:
            i += 1
            continue
        end = i
        while end < len(found) and window[end]:
            end += 1
        beyond = end  # a few lines of link text at the end of the article
        while beyond < len(found) and found[beyond][2] and not size[beyond]:
            beyond += 1
        if beyond - end < WINDOW:
            end = beyond
        kept += [text for text, _, inside in found[i:end] if text and (inside or not contained)]
        i = end
    return "\n".join(kept)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, ...)`` to page_id, url, text, n_chars (code points), a row for each row.

    Character references are decoded in text only; white space inside a block
    becomes one space; blocks are trimmed and joined by one line feed.  A null or
    empty page, and one without text outside menus and the like, gives an empty
    text.  An element that is opened and never closed is not taken to reach to
    the end of the page.  Repeated rows are treated alike, long pages take time in
    proportion to their length, an empty table gives no rows, and other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_batches, "page_id long, url string, text string, n_chars long")
