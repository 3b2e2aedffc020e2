"""Links of a parsed page, and what article-link scoring needs of them."""

from __future__ import annotations

from ..functions.url_join import host, normalise, parse_url, resolve
from .dom import Document

SKIP = ("#", "data:", "javascript:", "mailto:", "tel:")
_REL = {r.replace("_", ""): r for r in ("external", "follow", "no_follow", "no_opener", "no_referrer", "sponsored", "ugc")}
SCHEMA = (
    "array<struct<href:string,url:string,text:string,title:string,rel:array<string>,link_type:string,"
    "is_nofollow:boolean,target:string,hreflang:string>>"
)
CANDIDATES = "array<struct<pos:int,url:string,text:string,path:string,href:string,host:string,base_host:string>>"


def link_type(url, base):
    return _kind(parse_url(url), base)


def _kind(parsed, base):
    if parsed is None:
        return "unknown"
    if base is None:
        return "external"
    if parsed.host is None:
        return "internal"
    if base.host is None:
        return "external"
    return "internal" if parsed.host == base.host or parsed.host.endswith("." + base.host) else "external"


def rel_tokens(rel):
    return [_REL.get(t, "other") for t in (rel or "").lower().split()]


def _target(href, base):
    """The normalised URL of a trimmed link, and its parts; both None where there is none."""
    if href.startswith("//"):
        found = parse_url(f"{base.scheme if base is not None else 'https'}:{href}")
    elif href.startswith(("http://", "https://")):
        found = parse_url(href)
    else:
        found = parse_url(href, base) if base is not None else None
    if found is not None and not found.user and found.scheme in ("http", "https"):
        return found.text(fragment=False), found  # its text would be parsed to the same again
    url = normalise(resolve(href, base))
    return url, parse_url(url)


def links(doc: Document, base=None) -> list[dict]:
    out, seen = [], set()
    for el in doc.by_tag.get("a", ()):
        href = el.attrs.get("href", "").strip()
        if not href or href.startswith(SKIP) or href in seen:
            continue
        seen.add(href)
        url, parsed = _target(href, base)
        rel = rel_tokens(el.attrs.get("rel"))
        out.append(
            {
                "href": href, "url": url, "text": el.joined(" ") or href, "title": el.attrs.get("title"), "rel": rel,
                "link_type": _kind(parsed, base), "is_nofollow": "no_follow" in rel,
                "target": el.attrs.get("target"), "hreflang": el.attrs.get("hreflang"),
            }
        )
    return out


def dom_path(el, depth: int = 4) -> str:
    """Tags and sorted classes of up to ``depth`` ancestors below body, outermost first."""
    parts = []
    for a in el.ancestors():
        if len(parts) >= depth or a.tag in ("html", "body"):
            break
        parts.append(".".join([a.tag, *sorted(a.classes)]))
    return ">".join(reversed(parts))


def link_candidates(doc: Document, base=None, depth: int = 4) -> list[dict]:
    out = []
    for el in doc.select("a[href]"):
        href = el.attrs["href"].strip()
        if not href or href.startswith(("#", "javascript:", "mailto:", "tel:")):
            continue
        url = parse_url(href, base) if base is not None else None
        text = " ".join(" ".join(el.texts()).split())
        url = url.text() if url is not None else href
        out.append(
            {
                "pos": len(out), "url": url, "text": text, "path": dom_path(el, depth), "href": href, "host": host(url),
                "base_host": base.host if base is not None else None,
            }
        )
    return out


def absolute(hrefs, base) -> list[str]:
    """http(s) URLs of raw links, distinct, in order."""
    if base is None:
        return []
    found = (
        resolve(h, base, slashes=None, skip=SKIP, http_only=True) if not h.strip().startswith(("http:", "https:"))
        else (u.text() if (u := parse_url(h.strip(), base)) else None)
        for h in hrefs
    )
    return list(dict.fromkeys(u for u in found if u))


def select_links(doc: Document, selector: str, kind: str = "css") -> list[str]:
    """Raw href values (CSS), or attribute values, hrefs and texts (XPath) of the matches, distinct, in order."""
    if kind == "css":
        found = [n.attrs["href"] for n in doc.select(selector) if "href" in n.attrs]
    else:
        found = []
        for item in doc.xpath(selector):
            value = item[2] if isinstance(item, tuple) else item if isinstance(item, str) else item.attrs.get("href", "")
            found.append(value.strip())
        found = [f for f in found if f]
    return list(dict.fromkeys(found))
