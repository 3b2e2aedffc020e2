"""Feeds and sitemaps that a parsed page names."""

from __future__ import annotations

from ..functions.url_join import resolve
from .dom import Document

_FEEDS = (
    *((f'link[type="application/{t}"]', k) for t, k in (("rss+xml", "rss2"), ("atom+xml", "atom"), ("feed+json", "json"))),
    *((f'link[rel="alternate"][href$=".{e}"]', k) for e, k in (("rss", "rss2"), ("atom", "atom"), ("json", "json"))),
)
_SITEMAPS = ('link[rel="sitemap"]', 'link[type="application/xml"]', 'a[href*="sitemap"]')
FEEDS = "array<struct<feed_type:string,url:string,title:string,description:string>>"
SITEMAPS = "array<struct<url:string,sitemap_type:string,source:string>>"


def feeds(doc: Document, base=None) -> list[dict]:
    out, seen = [], set()
    for css, kind in _FEEDS:
        for el in doc.select(css):
            href = el.attrs.get("href", "").strip()
            url = (resolve(href, base) or href) if href else None
            if url and url not in seen:
                seen.add(url)
                out.append({"feed_type": kind, "url": url, "title": el.attrs.get("title"), "description": el.attrs.get("description")})
    return out


def sitemap_type(url: str) -> str:
    low = url.lower()
    if low.endswith(".txt"):
        return "text"
    if low.endswith((".gz", ".gzip")):
        return "gzip"
    return next((k for k in ("news", "image", "video", "index") if k in low), "xml")


def sitemaps(doc: Document, base=None) -> list[dict]:
    out, seen = [], set()
    for css in _SITEMAPS:
        for el in doc.select(css):
            href = el.attrs.get("href", "").strip()
            if "sitemap" in href.lower() and (url := resolve(href, base) or href) not in seen:
                seen.add(url)
                out.append({"url": url, "sitemap_type": sitemap_type(url), "source": "link_tag"})
    return out
