"""Content fingerprints, AMP facts and cache hints of a parsed page."""

from __future__ import annotations

from .content import BLOCK
from .dom import Document, Node

_BLOCK = BLOCK - frozenset("address details dialog fieldset main summary td th".split())
_MASK = (1 << 64) - 1
SCHEMA = (
    "struct<text_hash:decimal(20,0),structure_hash:decimal(20,0),main_content_hash:decimal(20,0),element_count:bigint,"
    "text_node_count:bigint,text_length:bigint,main_content_length:bigint>"
)
AMP = (
    "struct<is_amp:boolean,amp_url:string,canonical_url:string,has_amp_runtime:boolean,amp_components:array<string>,"
    "amp_version:string>"
)
CACHE = (
    "struct<max_age:bigint,stale_while_revalidate:bigint,etag:string,last_modified:string,should_cache:boolean,cache_key:string>"
)


def siphash13(data: bytes) -> int:
    """SipHash with one and three rounds and a zero key."""
    v0, v1, v2, v3 = 0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573

    def rounds(n):
        nonlocal v0, v1, v2, v3
        for _ in range(n):
            v0 = v0 + v1 & _MASK
            v1 = (v1 << 13 | v1 >> 51) & _MASK ^ v0
            v0 = (v0 << 32 | v0 >> 32) & _MASK
            v2 = v2 + v3 & _MASK
            v3 = (v3 << 16 | v3 >> 48) & _MASK ^ v2
            v0 = v0 + v3 & _MASK
            v3 = (v3 << 21 | v3 >> 43) & _MASK ^ v0
            v2 = v2 + v1 & _MASK
            v1 = (v1 << 17 | v1 >> 47) & _MASK ^ v2
            v2 = (v2 << 32 | v2 >> 32) & _MASK

    whole = len(data) // 8 * 8
    for k in range(0, whole, 8):
        m = int.from_bytes(data[k : k + 8], "little")
        v3 ^= m
        rounds(1)
        v0 ^= m
    m = int.from_bytes(data[whole:], "little") | (len(data) & 0xFF) << 56
    v3 ^= m
    rounds(1)
    v0 ^= m
    v2 ^= 0xFF
    rounds(3)
    return v0 ^ v1 ^ v2 ^ v3


def hash_text(text: str) -> int:
    """Hash of a string as the tuple of its bytes and an end mark."""
    return siphash13(text.encode() + b"\xff")


def flow(node: Node) -> str:
    out = ""
    for c in node.children:
        if c.tag is None:
            if t := c.text.strip():
                out += (" " if out and out[-1] != " " else "") + t
        elif c.tag not in ("#", "noscript", "script", "style"):
            if t := flow(c):
                block = c.tag in _BLOCK
                out += ("\n" if block and out and out[-1] != "\n" else "") + t + ("\n" if block else "")
    return out


def main_content(doc: Document) -> str:
    for css in "article main [role=main] .content .post-content".split():
        el = doc.first(css)
        if el is not None and len((t := flow(el)).encode()) > 50:
            return t
    return flow(doc.body if doc.body is not None else doc.root)


def structure(doc: Document) -> str:
    """Tags with ids, kinds of links and depths, in document order."""
    depth, out = {doc.root: 0}, []
    for n in doc.all:
        d = depth.setdefault(n, 0 if n.parent is None else depth[n.parent] + 1)
        mark = ""
        if n.tag == "a":
            href = n.attrs.get("href")
            mark = "[no]" if href is None else "[ext]" if href.startswith("http") else "[rel]"
        elif n.tag == "img":
            mark = "[img]"
        out.append(f"<{n.tag}{'#' + n.attrs['id'] if 'id' in n.attrs else ''}{mark}:{d}")
    return "".join(out)


def fingerprint(doc: Document, base=None) -> dict:
    text, main = flow(doc.root), main_content(doc)
    return {
        "text_hash": hash_text(text), "structure_hash": hash_text(structure(doc)), "main_content_hash": hash_text(main),
        "element_count": len(doc.all), "text_node_count": doc.n_full_text, "text_length": len(text.encode()),
        "main_content_length": len(main.encode()),
    }


def amp(doc: Document, base=None) -> dict:
    link = doc.first("link[rel=amphtml]")
    canonical = next((e for e in doc.by_tag.get("link", ()) if e.attrs.get("rel", "").lower() == "canonical"), None)
    sources = [e.attrs["src"] for e in doc.select("script[src]")]
    parts = [e.attrs.get("custom-element", e.attrs.get("custom-template")) for e in doc.select("script[custom-template], script[custom-element]")]
    version = None
    for src in sources:
        if "cdn.ampproject" not in src or "/" not in src:
            continue
        if src.rsplit("/", 1)[1] == "v0.js":
            found = [p[2:].lstrip("-") for p in src.split("/") if p.startswith("v0") and len(p) > 2]
            version = next((v for v in found if v not in ("", ".js")), None)
            break
    return {
        "is_amp": "amp" in doc.root.attrs or "amp" in doc.root.classes or "⚡" in doc.root.attrs,
        "amp_url": link.attrs.get("href") if link is not None else None,
        "canonical_url": canonical.attrs.get("href") if canonical is not None else None,
        "has_amp_runtime": any("cdn.ampproject.org" in s for s in sources), "amp_components": list(dict.fromkeys(parts)),
        "amp_version": version,
    }


def _seconds(text):
    text = text.strip()
    return int(text) if text.isascii() and text.isdigit() and len(text) < 19 else None


def cache_hints(doc: Document, base=None) -> dict:
    out = dict(max_age=None, stale_while_revalidate=None, etag=None, last_modified=None, should_cache=False, cache_key=None)
    never = False
    for el in doc.select("meta[http-equiv][content]"):
        name, value = el.attrs["http-equiv"].lower(), el.attrs["content"]
        if name == "cache-control":
            said = [d.strip().lower() for d in value.split(",")]
            if any(d in ("no-cache", "no-store", "private") for d in said):
                never = True
            else:
                for d in said:
                    for key in ("max-age", "stale-while-revalidate"):
                        if d.startswith(key + "="):
                            out[key.replace("-", "_")] = _seconds(d[len(key) + 1 :])
        elif name == "pragma":
            never = never or "no-cache" in value.lower()
        elif name in ("etag", "last-modified"):
            out[name.replace("-", "_")] = value
    if not never:
        out["should_cache"] = True
        out["max_age"] = 300 if out["max_age"] is None else out["max_age"]
    if (el := doc.first("title")) is not None and (title := el.joined()):
        out["cache_key"] = f"page-{hash_text(title)}"
    return out
