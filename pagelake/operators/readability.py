"""Readable article of a page, after the public Readability heuristics: paragraphs lend their score to parent and
grandparent, link density takes from it, siblings of the best candidate join it."""

from __future__ import annotations

import json
import re

from .content import octets
from .dom import HEADINGS, Document, Node, outer_html
from .metadata import meta, named, propertied, title

_UNLIKELY = re.compile(
    "ad-break|agegate|banner|breadcrumb|combx|comment|community|cookie|disqus|extra|footer|gdpr|header|legends|menu|modal"
    "|pager|pagination|popup|promo|related|remark|replies|rss|share|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|yom",
    re.I,
)
_MAYBE = re.compile("and|article|body|column|content|main|shadow", re.I)
_GOOD = re.compile("article|blog|body|content|entry|hentry|h-entry|main|page|post|story|text", re.I)
_BAD = re.compile("-ad-|banner|combx|comment|contact|foot|footer|gdpr|hidden|masthead|media|meta|outbrain|promo|related|share|sidebar|sponsor|widget", re.I)
_BYLINE = re.compile("author|byline|dateline|writtenby|p-author", re.I)
_DROP = frozenset("aside button footer form iframe input link nav noscript object script select style textarea embed".split())
_START = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3,
          "form": -3, "th": -5, **{f"h{k}": -5 for k in range(1, 7)}}
SCHEMA = "struct<title:string,content:string,html:string,date:string,author:string,description:string>"


def _weight(n: Node) -> int:
    marks = [n.attrs.get("class", ""), n.attrs.get("id", "")]
    return sum(25 * bool(_GOOD.search(m)) - 25 * bool(_BAD.search(m)) for m in marks if m)


def _text(n: Node, gone) -> str:
    out, stack = [], [n]
    while stack:
        x = stack.pop()
        if x.tag is None:
            out.append(x.text)
        elif x.tag != "#" and x not in gone:
            stack.extend(reversed(x.children))
    return re.sub(r"\s+", " ", "".join(out)).strip()


def _density(doc, n, gone):
    size = len(_text(n, gone))
    return sum(len(_text(a, gone)) for a in doc.select("a", n)) / size if size else 0.0


def _dropped(doc: Document):
    gone = set()
    for n in doc.all:
        if n.tag in ("html", "body", "a"):
            continue
        marks = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"
        style = n.attrs.get("style", "").replace(" ", "").lower()
        if n.tag in _DROP or "hidden" in n.attrs or "display:none" in style or n.attrs.get("aria-hidden") == "true":
            gone.add(n)
        elif _UNLIKELY.search(marks) and not _MAYBE.search(marks) and n.tag not in ("article", "main"):
            gone.add(n)
    return gone


def _best(doc: Document, gone):
    scores: dict[Node, float] = {}
    for n in doc.all:
        if n.tag not in ("p", "td", "pre", "section", *(HEADINGS - {"h1"})) or n in gone or any(a in gone for a in n.ancestors()):
            continue
        text = _text(n, gone)
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + text.count("，") + min(len(text) // 100, 3)
        for level, a in enumerate(list(n.ancestors())[:5]):
            if a.tag == "html":
                break
            if a not in scores:
                scores[a] = _START.get(a.tag, 0) + _weight(a)
            scores[a] += points / (1 if level == 0 else 2 if level == 1 else level * 3)
    if not scores:
        return None, {}
    final = {n: s * (1 - _density(doc, n, gone)) for n, s in scores.items()}
    return max(final, key=lambda n: (final[n], -n.id)), final


def _parts(doc, top, scores, gone):
    if top.parent is None or top.tag == "body":
        return [top]
    least, out = max(10.0, scores[top] * 0.2), []
    for s in top.parent.elements():
        if s is top:
            out.append(s)
        elif s not in gone:
            bonus = scores[top] * 0.2 if s.attrs.get("class") and s.attrs.get("class") == top.attrs.get("class") else 0
            text, density = _text(s, gone), _density(doc, s, gone)
            if scores.get(s, -1e9) + bonus >= least or (
                s.tag == "p" and ((len(text) > 80 and density < 0.25) or (0 < len(text) < 80 and density == 0 and re.search(r"\.( |$)", text)))
            ):
                out.append(s)
    return out


def _clean_html(n: Node, gone) -> str:
    if n.tag is None or n.tag == "#":
        return outer_html(n) if n.tag is None else ""
    if n in gone:
        return ""
    keep = {k: v for k, v in n.attrs.items() if k in ("href", "src", "alt", "title", "colspan", "rowspan", "srcset")}
    bare = Node(n.tag, keep)
    shell = outer_html(bare)
    inner = "".join(_clean_html(c, gone) for c in n.children)
    return shell[: shell.rfind("</")] + inner + f"</{n.tag}>" if shell.endswith(f"</{n.tag}>") else shell


def _markdown(n: Node, gone, depth=0) -> str:
    if n.tag is None:
        return re.sub(r"\s+", " ", n.text)
    if n.tag == "#" or n in gone:
        return ""
    inner = "".join(_markdown(c, gone, depth + (n.tag in ("ul", "ol"))) for c in n.children)
    bare = inner.strip()
    if n.tag in HEADINGS:
        return f"\n\n{'#' * int(n.tag[1])} {bare}\n\n" if bare else ""
    if n.tag in ("strong", "b"):
        return f"**{bare}**" if bare else ""
    if n.tag in ("em", "i"):
        return f"*{bare}*" if bare else ""
    if n.tag == "a" and bare and n.attrs.get("href"):
        return f"[{bare}]({n.attrs['href']})"
    if n.tag == "code" and (n.parent is None or n.parent.tag != "pre"):
        return f"`{bare}`" if bare else ""
    if n.tag == "pre":
        return "\n\n```\n" + "".join(n.texts()).strip("\n") + "\n```\n\n"
    if n.tag == "li":
        mark = "1." if n.parent is not None and n.parent.tag == "ol" else "-"
        return f"\n{'  ' * max(depth - 1, 0)}{mark} {bare}" if bare else ""
    if n.tag == "blockquote":
        return "\n\n" + "\n".join("> " + line for line in bare.split("\n")) + "\n\n" if bare else ""
    if n.tag == "br":
        return "\n"
    if n.tag == "hr":
        return "\n\n---\n\n"
    if n.tag == "img":
        return f"![{n.attrs.get('alt', '')}]({n.attrs['src']})" if n.attrs.get("src") else ""
    if n.tag in ("p", "div", "section", "article", "table", "tr", "ul", "ol", "dl", "figure", "main"):
        return f"\n\n{bare}\n\n" if bare else ""
    return inner + (" " if n.tag in ("td", "th") else "")


def _linked_data(doc):
    for s in doc.select('script[type="application/ld+json"]'):
        try:
            value = json.loads(s.joined())
        except ValueError:
            continue
        for v in value if isinstance(value, list) else [value]:
            if isinstance(v, dict) and re.search("Article|Posting|Report", str(v.get("@type", ""))):
                author = v.get("author")
                author = author[0] if isinstance(author, list) and author else author
                name = author.get("name") if isinstance(author, dict) else author
                yield "author", name
                yield "date", v.get("datePublished")
                yield "description", v.get("description")
                yield "title", v.get("headline") or v.get("name")


def article(doc: Document, base=None) -> dict:
    """Title, text as Markdown, cleaned html, date, author and description; nulls where nothing is found."""
    linked = {k: v for k, v in _linked_data(doc) if isinstance(v, str) and v.strip()}
    gone = _dropped(doc)
    top, scores = _best(doc, gone)
    out = {"title": linked.get("title") or title(doc) or "", "content": "", "html": None}
    if top is not None:
        parts = _parts(doc, top, scores, gone)
        out["html"] = '<div class="page">' + "".join(_clean_html(p, gone) for p in parts) + "</div>"
        text = "\n\n".join(_markdown(p, gone) for p in parts)
        out["content"] = re.sub(r"[ \t]*\n[ \t]*(?=\n)", "\n", re.sub(r"\n{3,}", "\n\n", text)).strip()
    byline = next((n.joined() for n in doc.all if n.attrs.get("rel") == "author" or _BYLINE.search(f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}")), None)
    byline = byline if byline and len(byline) < 100 else None
    first = next((t for p in doc.by_tag.get("p", ()) if p not in gone and (t := _text(p, gone))), None)
    out["date"] = linked.get("date") or propertied(doc, "article:published_time") or meta(doc, "date")
    out["author"] = linked.get("author") or named(doc, "author") or propertied(doc, "article:author") or byline
    out["description"] = linked.get("description") or propertied(doc, "og:description") or named(doc, "description") or first
    return out


def readable_or_selected(doc: Document, css: str) -> str:
    """Cleaned article html of more than 100 bytes, else the text of the first match of a selector."""
    html = article(doc)["html"]
    if html is not None and octets(html) > 100:
        return html
    el = doc.first(css)
    return el.joined("\n") if el is not None else ""
