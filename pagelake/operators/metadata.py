"""Page metadata and structured data from a parsed page."""

from __future__ import annotations

import json

from ..functions.url_join import resolve
from .dom import Document

OG = "audio description image locale site_name title type url video".split()
TWITTER = "card creator description image site title".split()
_OWN = frozenset("author date description generator googlebot keywords robots theme-color viewport".split())
_OWN_PREFIX = ("al:", "article:", "og:", "twitter:")

SCHEMA = (
    "struct<title:string,description:string,keywords:array<string>,author:string,generator:string,canonical:string,"
    "base_url:string,language:string,charset:string,viewport:string,"
    "robots:struct<index:boolean,follow:boolean,archive:boolean,cache:boolean,snippet:boolean,max_snippet:int,"
    "max_image_preview:string,max_video_preview:int,raw:string>,"
    "opengraph:struct<" + ",".join(f"{'og_type' if k == 'type' else k}:string" for k in OG) + ",extra:map<string,string>>,"
    "twitter:struct<" + ",".join(f"{k}:string" for k in TWITTER) + ",extra:map<string,string>>,"
    "alternates:array<struct<hreflang:string,href:string>>,favicon:string,apple_touch_icon:string,theme_color:string,"
    "published_date:string,modified_date:string,schema_type:string,custom:map<string,string>>"
)
STRUCTURED = "array<struct<format:string,schema_type:string,raw:string,properties:map<string,string>>>"


def _link(href, base):
    return resolve(href, base, slashes=None, verbatim_absolute=False, without_base="verbatim", skip=("data:", "javascript:"))


def _full(value):
    value = value.strip() if value is not None else ""
    return value or None


def _attr(doc: Document, css: str, name: str = "content"):
    el = doc.first(css)
    return _full(el.attrs.get(name)) if el is not None else None


def named(doc, name):
    return _attr(doc, f'meta[name="{name}"]')


def propertied(doc, name):
    return _attr(doc, f'meta[property="{name}"]')


def meta(doc, name):
    return named(doc, name) or propertied(doc, name)


def title(doc):
    for value in (propertied(doc, "og:title"), named(doc, "twitter:title")):
        if value:
            return value
    for tag in ("title", "h1"):
        el = doc.first(tag)
        if el is not None and (t := el.joined()):
            return t
    return None


def charset(doc):
    if c := _attr(doc, "meta[charset]", "charset"):
        return c
    el = doc.first('meta[http-equiv="Content-Type"]')
    content = el.attrs.get("content") if el is not None else None
    at = content.lower().find("charset=") if content else -1
    return _full(content[at + 8 :]) if at >= 0 else None


def language(doc):
    return _full(doc.root.attrs.get("lang")) or _attr(doc, 'meta[http-equiv="content-language"]')


def _icon_size(sizes):
    best = None
    for s in sizes.split():
        parts = s.split("x")
        if len(parts) == 2:
            try:
                best = max(best or -1, int(parts[0]), int(parts[1]))
            except ValueError:
                continue
    return best


def favicon(doc, base):
    best, best_size = None, -1
    for el in doc.select("link[rel=apple-touch-icon-precomposed], link[rel~=icon], link[rel='shortcut icon']"):
        href = el.attrs.get("href")
        if href is None:
            continue
        size = _icon_size(el.attrs.get("sizes", ""))
        if size is not None and size > best_size:
            best, best_size = href, size
        elif size is None and best is None:
            best = href
    return _link(best, base)


def robots(doc):
    out = dict(index=True, follow=True, archive=True, cache=True, snippet=True, max_snippet=-1,
               max_image_preview="large", max_video_preview=-1, raw=None)
    el = doc.first("meta[name=ROBOTS], meta[name=robots]")
    content = el.attrs.get("content") if el is not None else None
    if content is None:
        return out
    out["raw"] = content
    for d in content.split(","):
        d = d.strip().lower()
        key, _, value = d.partition(":")
        value = value.strip()
        if d.startswith("no") and d[2:] in ("index", "follow", "archive", "cache", "snippet"):
            out[d[2:]] = False
        elif key in ("max-snippet", "max-video-preview") and ":" in d:
            try:
                out[key.replace("-", "_")] = int(value)
            except ValueError:
                out[key.replace("-", "_")] = -1
        elif key == "max-image-preview" and ":" in d:
            out["max_image_preview"] = value
    return out


def _extra(doc, attr, prefix, known):
    out = {}
    for el in doc.by_tag.get("meta", ()):
        name, content = el.attrs.get(attr), el.attrs.get("content")
        if name is not None and content is not None:
            low = name.lower()
            if low.startswith(prefix) and low[len(prefix) :] not in known:
                out[name] = content
    return out


def opengraph(doc):
    out = {("og_type" if k == "type" else k): propertied(doc, "og:" + k) for k in OG}
    return out | {"extra": _extra(doc, "property", "og:", OG)}


def twitter(doc):
    return {k: named(doc, "twitter:" + k) for k in TWITTER} | {"extra": _extra(doc, "name", "twitter:", TWITTER)}


def alternates(doc, base):
    out = []
    for el in doc.select('link[rel="alternate"]'):
        if href := el.attrs.get("href", "").strip():
            out.append({"hreflang": el.attrs.get("hreflang", "").strip(), "href": _link(href, base) or href})
    return out


def custom(doc):
    out = {}
    for el in doc.by_tag.get("meta", ()):
        name = el.attrs.get("name", el.attrs.get("property"))
        content = el.attrs.get("content")
        if name and content and name.lower() not in _OWN and not name.lower().startswith(_OWN_PREFIX):
            out[name] = content
    return out


def json_ld(doc):
    out = []
    for el in doc.select('script[type="application/ld+json"]'):
        raw = el.joined()
        if not raw:
            continue
        kind, props = None, {}
        try:
            value = json.loads(raw)
        except ValueError:
            value = None
        if isinstance(value, dict):
            props = {k: json.dumps(v, ensure_ascii=False, separators=(",", ":")) for k, v in value.items()}
            for key in ("@type", "type"):
                if isinstance(value.get(key), str):
                    kind = value[key]
        out.append({"format": "json_ld", "schema_type": kind, "raw": raw, "properties": props})
    return out


def microdata(doc):
    out = []
    for el in doc.select("[itemscope]"):
        kind = el.attrs.get("itemtype")
        if kind is None:
            continue
        props = {}
        for child in doc.select("[itemprop]", el):
            if "itemscope" in child.attrs:
                continue
            value = next((child.attrs[a] for a in ("content", "src", "href") if a in child.attrs), None)
            value = child.joined() if value is None else value.strip()
            props[child.attrs["itemprop"]] = json.dumps(value, ensure_ascii=False)
        out.append({"format": "microdata", "schema_type": kind.rsplit("/", 1)[-1], "raw": None, "properties": props})
    return out


def structured_data(doc, base=None):
    return json_ld(doc) + microdata(doc)


def metadata(doc: Document, base=None) -> dict:
    keywords = named(doc, "keywords")
    structured = structured_data(doc)
    canonical, touch = doc.first('link[rel="canonical"]'), doc.first(
        "link[rel=apple-touch-icon-precomposed], link[rel=apple-touch-icon]"
    )
    return {
        "title": title(doc), "description": meta(doc, "description"),
        "keywords": [k for k in map(str.strip, (keywords or "").split(",")) if k],
        "author": meta(doc, "author"), "generator": meta(doc, "generator"),
        "canonical": _link(canonical.attrs.get("href"), base) if canonical is not None else None,
        "base_url": _attr(doc, "base", "href"), "language": language(doc), "charset": charset(doc),
        "viewport": meta(doc, "viewport"), "robots": robots(doc), "opengraph": opengraph(doc), "twitter": twitter(doc),
        "alternates": alternates(doc, base), "favicon": favicon(doc, base),
        "apple_touch_icon": _link(touch.attrs.get("href"), base) if touch is not None else None,
        "theme_color": meta(doc, "theme-color"),
        "published_date": meta(doc, "date") or meta(doc, "article:published_time"),
        "modified_date": meta(doc, "article:modified_time"),
        "schema_type": structured[0]["schema_type"] if structured else None, "custom": custom(doc),
    }
