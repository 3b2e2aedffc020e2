"""Headings, outline, paragraphs, lists, tables, code, quotes and images of a parsed page, and its readable text."""

from __future__ import annotations

import re

from ..functions.url_join import resolve
from .dom import Document, Node

BLOCK = frozenset(
    """address article aside blockquote br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2
    h3 h4 h5 h6 header hr li main nav ol p pre section summary table td th tr ul""".split()
)
INLINE = frozenset(
    """a abbr acronym b bdi bdo br button cite code data del dfn em i img input ins kbd label mark meter output
    progress q rp rt ruby s samp select small span strong sub sup textarea time u var wbr""".split()
)
SKIPPED = frozenset("canvas embed iframe math noscript object script style svg template".split())
BOILERPLATE = frozenset("aside footer header nav noscript script style".split())
CONTENT = tuple(
    """article main [role=main] .content .post-content .entry-content .article-content
    .post-body .article-body #content #main-content .main-content""".split()
)
LANGUAGES = frozenset(
    """zig zephir yara yang yaml xsl xml xaml x86asm wolfram webassembly wdl wasm vue visualbasic vim vhdl verilog vbnet
    vala v typoscript typescript twig turing toml thrift text tex terraform tcl systemverilog swift svelte stylus stata
    stan sql sparql solidity snakemake smarty smalltalk shell scss scilab scheme scala sass sas rust ruby robot riscv
    restructuredtext red rebol reason rasql ragel racket r qml q python pyramid purebasic puppet pug protobuf promql
    prolog processing powershell postgresql plsql pkl php perl pascal opengl opencl odin octave ocaml numpy node nix nim
    nginx nasm mysql msl mql5 mql4 mojo modelica mips minizinc meson mcfunction matlab mathematica markdown makefile m4
    lua llvm livescript lisp lilypond less latex kotlin julia json jq jinja javascript java io ini idl hy http html hlsl
    hcl haxe haskell groovy graphql gradle golo go gnuplot glyph glsl git gherkin genie gdscript gcode gams fsharp
    fortran flow fish fasta f# excel erlang emacs elm elixir dot docker django diff delphi dart d cypher cuda css cql
    crystal cpp coffeescript cmake clojure caml csharp c# c++ c bison batch basic bash awk assembly asp asm arduino
    applescript apache ada actionscript abap""".split()
)
_SPACES = re.compile(r"\s+")
_NEWLINES = re.compile(r"\n{3,}")

HEADING = "struct<level:int,text:string,id:string,classes:array<string>>"
OUTLINE = "array<struct<idx:int,parent_idx:int,depth:int,level:int,text:string>>"
LISTS = "array<struct<list_idx:int,list_type:string,path:array<int>,level:int,text:string>>"
_ROW = "struct<cells:array<struct<content:string,is_header:boolean,colspan:int,rowspan:int>>,is_header_row:boolean>"
TABLES = f"array<struct<caption:string,headers:array<{_ROW}>,rows:array<{_ROW}>,column_count:bigint,summary:string>>"
CODE = "array<struct<code:string,language:string,line_count:bigint,is_inline:boolean,filename:string>>"
QUOTES = "array<struct<text:string,cite:string,cite_url:string>>"
IMAGES = (
    "array<struct<src:string,url:string,alt:string,title:string,width:int,height:int,srcset:string,sizes:string,"
    "loading:string,is_decorative:boolean>>"
)


def octets(text: str) -> int:
    return len(text.encode("utf-8", "replace"))


def unsigned(value, most=(1 << 32) - 1):
    """A number as an attribute holds it, or None."""
    if value is None or not re.fullmatch(r"\+?[0-9]+", value):
        return None
    n = int(value)
    return n if n <= most and n < 1 << 31 else None


def flow(node: Node, skip=BOILERPLATE, depth: int | None = None) -> str:
    """Readable text: spaces between text nodes, line breaks around blocks, trimmed at every level."""
    if depth is not None and depth <= 0:
        return ""
    out = ""
    for c in node.children:
        if c.tag is None:
            t = _SPACES.sub(" ", c.text).strip()
            if t:
                out += (" " if out and out[-1] not in " \n" else "") + t
        elif c.tag != "#" and c.tag not in skip:
            block = c.tag in BLOCK
            if block and out and out[-1] != "\n":
                out += "\n"
            out += flow(c, skip, None if depth is None else depth - 1)
            if block and not out.endswith("\n"):
                out += "\n"
    return _NEWLINES.sub("\n\n", out).strip()


def element_text(node: Node) -> str:
    """Unfiltered variant: every text node is followed by a space."""
    out = ""
    for c in node.children:
        if c.tag is None:
            t = _SPACES.sub(" ", c.text).strip()
            out += t + " " if t else ""
        elif c.tag != "#":
            block = c.tag in BLOCK
            if block and out and out[-1] != "\n":
                out += "\n"
            out += element_text(c)
            if block and not out.endswith("\n"):
                out += "\n"
    return _NEWLINES.sub("\n\n", out).strip()


def main_text(doc: Document, base=None, more=(), least: int = 20) -> str:
    for css in (*CONTENT, *more):
        el = doc.first(css)
        if el is not None and octets(t := flow(el)) > least:
            return t
    return flow(doc.body if doc.body is not None else doc.root)


def _heading(el):
    text = el.joined()
    return {"level": int(el.tag[1]), "text": text, "id": el.attrs.get("id"), "classes": el.classes} if text else None


def headings(doc: Document, base=None) -> list[dict]:
    """By level, then in document order."""
    return [h for k in range(1, 7) for el in doc.by_tag.get(f"h{k}", ()) if (h := _heading(el))]


def main_heading(doc: Document, base=None):
    for tag in ("h1", "h2"):
        el = doc.first(tag)
        if el is not None and (h := _heading(el)):
            return h
    return None


def outline(doc: Document, base=None) -> list[dict]:
    out, open_ = [], []
    for k, h in enumerate(headings(doc)):
        while open_ and out[open_[-1]]["level"] >= h["level"]:
            open_.pop()
        out.append(
            {"idx": k, "parent_idx": open_[-1] if open_ else None, "depth": len(open_), "level": h["level"], "text": h["text"]}
        )
        open_.append(k)
    return out


def paragraphs(doc: Document, base=None, least: int = 20) -> list[str]:
    return [t for el in doc.by_tag.get("p", ()) if octets(t := el.joined()) >= least]


def _items(el):
    """(text, nested items) of each direct li that has text of its own; of nested lists the last one counts."""
    out = []
    for li in el.elements():
        if li.tag != "li":
            continue
        parts, nested = [], []
        for c in li.children:
            if c.tag is None:
                parts.append(c.text.strip())
            elif c.tag in ("ul", "ol"):
                nested = _items(c) or nested
            elif c.tag != "#":
                parts.append(c.joined())
        text = " ".join(p for p in parts if p)
        if text:
            out.append((text, nested))
    return out


def lists(doc: Document, base=None) -> list[dict]:
    """Items of all top-level lists: unordered, then ordered, then definition lists; ``path`` numbers each level."""
    out, n = [], 0

    def emit(kind, items, path):
        for k, (text, nested) in enumerate(items):
            out.append({"list_idx": n, "list_type": kind, "path": [*path, k], "level": len(path), "text": text})
            emit(kind, nested, [*path, k])

    for tag, kind in (("ul", "unordered"), ("ol", "ordered")):
        for el in doc.by_tag.get(tag, ()):
            if el.parent is not None and el.parent.tag == "li":
                continue
            if items := _items(el):
                emit(kind, items, [])
                n += 1
    for el in doc.by_tag.get("dl", ()):
        term, items = None, []
        for c in el.elements():
            text = c.joined()
            if c.tag == "dt" and text:
                term = text
            elif c.tag == "dd" and text:
                items.append((f"{term}: {text}" if term is not None else text, []))
        if items:
            emit("definition", items, [])
            n += 1
    return out


def _row(el):
    cells = [
        {
            "content": c.joined(), "is_header": c.tag == "th", "colspan": _or(unsigned(c.attrs.get("colspan")), 1),
            "rowspan": _or(unsigned(c.attrs.get("rowspan")), 1),
        }
        for c in el.elements() if c.tag in ("td", "th")
    ]
    return {"cells": cells, "is_header_row": all(c["is_header"] for c in cells)} if cells else None


def _or(value, default):
    return default if value is None else value


def tables(doc: Document, base=None) -> list[dict]:
    out = []
    for el in doc.by_tag.get("table", ()):
        caption, head, body = (doc.first(t, el) for t in ("caption", "thead", "tbody"))
        headers = [r for e in (head.elements() if head is not None else ()) if (r := _row(e))]
        direct = (body if body is not None else el).elements()
        rows = [r for e in direct if e.tag == "tr" and (r := _row(e))]
        if headers or rows:
            out.append(
                {
                    "caption": (caption.joined() or None) if caption is not None else None, "headers": headers, "rows": rows,
                    "column_count": max(len(r["cells"]) for r in headers + rows), "summary": None,
                }
            )
    return out


def _code(el, inline):
    code, language = el.joined(), None
    for part in el.classes:
        for cut in ("language-", "lang-", ""):
            if part.startswith(cut) and part[len(cut) :].strip().lower() in LANGUAGES:
                language = part[len(cut) :]
                break
        if language is not None:
            break
    if language is None and el.attrs.get("data-lang", "").strip().lower() in LANGUAGES:
        language = el.attrs["data-lang"]
    lines = code.split("\n")
    return {
        "code": code, "language": language, "line_count": len(lines) - (lines[-1] == ""), "is_inline": inline,
        "filename": el.attrs.get("data-filename", el.attrs.get("filename")),
    }


def code_blocks(doc: Document, base=None) -> list[dict]:
    pre = [e[0] for p in doc.by_tag.get("pre", ()) if (e := p.elements()) and e[0].tag == "code"]
    inline = [e for e in doc.by_tag.get("code", ()) if e.parent is None or e.parent.tag != "pre"]
    return [_code(e, False) for e in pre] + [_code(e, True) for e in inline]


def quotes(doc: Document, base=None) -> list[dict]:
    out = []
    for el in doc.by_tag.get("blockquote", ()):
        if octets(text := el.joined()) >= 10:
            inner = doc.first("cite", el)
            out.append(
                {"text": text, "cite": el.attrs.get("cite"), "cite_url": (inner.joined() or None) if inner is not None else None}
            )
    return out


def images(doc: Document, base=None) -> list[dict]:
    out = []
    for el in doc.by_tag.get("img", ()):
        src = el.attrs.get("src", "").strip()
        if not src or src.startswith("data:"):
            continue
        a = el.attrs.get
        out.append(
            {
                "src": src, "url": resolve(src, base, verbatim_absolute=True) if base is not None else None,
                "alt": a("alt", ""), "title": a("title"), "width": unsigned(a("width")), "height": unsigned(a("height")),
                "srcset": a("srcset"), "sizes": a("sizes"), "loading": "lazy" if a("loading") == "lazy" else "eager",
                "is_decorative": not a("alt"),
            }
        )
    return out


def stats(doc: Document, base=None) -> dict:
    """Sizes and counts of the tree; ``node_count`` is the number of nodes at the top."""
    return {
        "html_size": octets(doc._text), "node_count": len(doc.top), "element_count": len(doc.all),
        "text_node_count": doc.n_text, "comment_count": doc.comments,
    }


STATS = "struct<html_size:bigint,node_count:bigint,element_count:bigint,text_node_count:bigint,comment_count:bigint>"
