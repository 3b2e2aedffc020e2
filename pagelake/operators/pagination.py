"""Pagination of a parsed page."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl

from ..functions.url_join import Url, resolve
from .dom import Document

_IN_QUERY = re.compile(r"[?&](?:pg|page|p)=([0-9]+)", re.I)
_IN_PATH = re.compile(r"/page/([0-9]+)/?", re.I)
_LOOSE = re.compile(r"(?:pg|page|p)[=/]([0-9]+)", re.I)
_TAIL = re.compile(r"/([0-9]+)/?\Z")
_OF = re.compile(r"(?:page|pg?)\s*([0-9]+)\s*(?:/|of)\s*([0-9]+)", re.I)
_PAGE = re.compile(r"(?:page|pg?)\s*([0-9]+)", re.I)
_TOTAL = re.compile(r"(?:of|total|共)\s*([0-9]+)\s*(?:items?|results?|个|条|页)?[个条]?[一-鿿]*\s*\Z", re.I)
_PREV = re.compile(r"\s*(?:prev|previous|上一(?:页|頁|篇)|[«<‹←])\s*\Z", re.I)
_NEXT = re.compile(r"\s*(?:next|下一(?:页|頁|篇)|[»>›→])\s*\Z", re.I)
_MORE = re.compile(r"(?:load|show|view)\s*more|(?:加载|展开|查看)更多", re.I)
_ENDLESS = re.compile(r"infinite[\s-]?(?:load|scroll)|endless[\s-]?(?:page|scroll)", re.I)
_OFFSET = re.compile(r"[?&](?:from|index|offset|start)=[0-9]+", re.I)
_CURSOR = re.compile(r"[?&](?:after|before|cursor)=[^&]+", re.I)
_LINKS = (
    *(f".{c} a" for c in ("pagination", "pager", "page-nav", "page-navigation", "pages")), ".page-numbers",
    *(f"{t}.pagination a" for t in ("nav", "ul", "div")), *(f'[class*="{c}"] a' for c in ("pagination", "pager", "page-nav")),
)
_SCROLL = (
    '[class*="infinite-scroll"], [id*="infinite-scroll"], [data-infinite-scroll], [data-infinite], [class*="endless-scroll"]'
)
_LOAD = (
    ".view-more, [class*='load-more'], [class*='loadmore'], [class*='show-more'], [data-load-more], [data-loadmore]"
)
SCHEMA = (
    "struct<current_page:int,total_pages:int,prev_url:string,next_url:string,first_url:string,last_url:string,"
    "page_urls:array<struct<url:string,page_number:int,is_current:boolean>>,pagination_type:string,"
    "has_infinite_scroll:boolean,has_load_more:boolean,items_per_page:int,total_items:int>"
)


def _link(href, base):
    return resolve(href, base, without_base="verbatim")


def _u32(text):
    n = int(text) if len(text) < 12 else 1 << 40
    return n if n < 1 << 32 else None


def page_number(url: str) -> int | None:
    for pattern in (_IN_QUERY, _IN_PATH, _LOOSE, _TAIL):
        if (m := pattern.search(url)) and (n := _u32(m[1])) is not None:
            return n
    return None


def page_info(text: str) -> tuple[int | None, int | None, int | None]:
    """(current, pages, items) as a text such as "Page 2 of 9" says."""
    if m := _OF.search(text):
        return _u32(m[1]), _u32(m[2]), None
    page = _PAGE.search(text)
    # only a number at the end counts, so the search may start near it
    total = _TOTAL.search(text[-400:].rstrip() if len(text) > 400 else text)
    return _u32(page[1]) if page else None, None, _u32(total[1]) if total else None


def rel_links(doc: Document, base=None) -> dict:
    out = {}
    for el in doc.select("link[rel][href]"):
        rel = {"previous": "prev"}.get(r := el.attrs["rel"].lower(), r)
        if rel in ("next", "prev", "first", "last"):
            out[rel] = _link(el.attrs["href"], base) or el.attrs["href"]
    return out


def page_links(doc: Document, base=None) -> list[dict]:
    out, seen = [], set()
    for css in _LINKS:
        for el in doc.select(css):
            href = el.attrs.get("href", "").strip()
            if not href or href.startswith(("#", "javascript:")):
                continue
            url = _link(href, base) or href
            if url in seen:
                continue
            seen.add(url)
            text, number = el.joined(" "), page_number(url)
            if number is None and (m := _PAGE.search(text)):
                number = _u32(m[1])
            if number is None and re.fullmatch(r"\+?[0-9]{1,10}", text):
                number = _u32(text)
            marks = el.attrs.get("class", "")
            out.append({"url": url, "page_number": number or 0, "is_current": "active" in marks or "current" in marks})
    return out


def infinite_scroll(doc: Document) -> bool:
    return bool(doc.select(_SCROLL)) or any(_ENDLESS.search("".join(s.texts())) for s in doc.by_tag.get("script", ()))


def load_more(doc: Document) -> bool:
    return any(_MORE.search("".join(e.texts())) for e in doc.select(_LOAD))


def _kind(doc, pages, scroll, more):
    if scroll or more:
        return "infinite_scroll" if scroll else "load_more"
    if any(_CURSOR.search(p["url"]) for p in pages):
        return "cursor"
    if any(_OFFSET.search(p["url"]) for p in pages):
        return "offset"
    if sum(p["page_number"] > 0 for p in pages) >= 2:
        return "numbered"
    said = ["".join(e.texts()) for e in doc.select("a, span, button")]
    return "next_prev" if any(map(_PREV.match, said)) and any(map(_NEXT.match, said)) else "none"


def pagination(doc: Document, base: Url | None = None) -> dict:
    rel, pages = rel_links(doc, base), page_links(doc, base)
    marked = next((p["page_number"] for p in pages if p["is_current"]), None)
    before = page_number(rel["prev"]) if rel.get("prev") else None
    after = page_number(rel["next"]) if rel.get("next") else None
    current = marked
    if current is None:
        current = before + 1 if before is not None else max(after - 1, 0) if after is not None else 1
    scroll, more = infinite_scroll(doc), load_more(doc)
    kind = _kind(doc, pages, scroll, more)
    total = items = None
    if doc.body is not None:
        said, total, items = page_info("".join(doc.body.texts()))
        if current == 1 and said is not None:
            current = said
    if base is not None and base.query:
        for k, v in parse_qsl(base.query, keep_blank_values=True):
            if k in ("total", "pages"):
                if v.isascii() and v.isdigit() and _u32(v) is not None:
                    total = _u32(v)
                break
    clip = lambda n: n if n is None or n < 1 << 31 else None
    return {
        "current_page": clip(current), "total_pages": clip(total), "prev_url": rel.get("prev"), "next_url": rel.get("next"),
        "first_url": rel.get("first"), "last_url": rel.get("last"),
        "page_urls": [p | {"page_number": clip(p["page_number"])} for p in pages], "pagination_type": kind,
        "has_infinite_scroll": scroll, "has_load_more": more, "items_per_page": None, "total_items": clip(items),
    }


def has_pagination(doc: Document, base=None) -> bool:
    if doc.select('link[rel="next"], link[rel="prev"], .pager, .page-nav, .page-numbers, [class*="pagination"]'):
        return True
    if infinite_scroll(doc) or load_more(doc):
        return True
    text = "".join(doc.body.texts()) if doc.body is not None else ""
    return bool(_PREV.match(text) or _NEXT.match(text) or _OF.search(text))


def _beside(doc, base, rel, places, label, step):
    el = doc.first(f'link[rel="{rel}"][href]')
    if el is not None and (url := _link(el.attrs["href"], base)):
        return url
    for css in places:
        for a in doc.select(css):
            if label.match("".join(a.texts())) and "href" in a.attrs:
                return _link(a.attrs["href"], base)
    pages = page_links(doc, base)
    current = next((p["page_number"] for p in pages if p["is_current"]), None)
    if current is None or current + step < 0 or (step < 0 and current <= 1):
        return None
    return next((p["url"] for p in pages if p["page_number"] == current + step), None)


def next_page(doc: Document, base=None):
    places = (*(f"a{c}" for c in ".next .next-page [rel=next]".split()), *(f".{c} a:last-child" for c in ("pagination", "pager")))
    return _beside(doc, base, "next", places, _NEXT, 1)


def prev_page(doc: Document, base=None):
    places = (*(f"a.{c}" for c in "prev previous prev-page".split()), "a[rel=prev]", *(f".{c} a:first-child" for c in ("pagination", "pager")))
    return _beside(doc, base, "prev", places, _PREV, -1)
