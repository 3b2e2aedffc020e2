"""HTML to a tree, in one pass: the only part of page analysis that Catalyst can't express.

The builder follows the HTML standard where it changes what is extracted: implied elements, void and
raw-text elements, automatic closing of paragraphs, list items, table parts and options, formatting
elements that reopen in the next block, entities decoded once. Of the adoption agency only its effect on
nesting is kept, and misplaced elements inside tables stay where they stand.
"""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RCDATA = frozenset(("title", "textarea"))
VERBATIM = RAW | RCDATA
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt""".split()
)
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
SCOPE = frozenset("applet caption html table td th marquee object template".split())
P_SCOPE = SCOPE | {"button"}
SPECIAL = CLOSES_P | SCOPE | frozenset("body head tbody thead tfoot tr button select option".split())

#: Elements whose closing tag does more than close them; those whose opening tag is treated otherwise than others.
_CLOSING = FORMAT | HEADINGS | frozenset("html body head p br form".split())
_OWN = HEADINGS | frozenset("li dd dt option optgroup tbody thead tfoot tr td th caption colgroup form button a".split())

#: Every repetition is possessive, and a tag, quote or declaration that nothing ends takes the rest of the text, so a page is read once.
_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>"
    r"|<[!?](?P<decl>[^>]*+)(?:>|\Z)|</(?![A-Za-z])[^>]*+(?:>|\Z)|(?P<rest></?[A-Za-z])",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_ENTITY = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.IGNORECASE) for t in RAW | RCDATA}
#: Deeper elements become siblings; formatting elements that stay open beyond so many are no longer reopened.
DEPTH, ACTIVE = 512, 100
_SPACE = " \t\n\r\f"


class Node:
    """An element, or a text (tag None) or comment (tag '#') node; ``end`` is its last descendant's number."""

    __slots__ = ("attrs", "children", "end", "id", "parent", "tag", "text")

    def __init__(self, tag, attrs=None, text=None):
        self.tag, self.attrs, self.text = tag, attrs, text
        self.children, self.parent, self.id, self.end = [], None, 0, 0

    def add(self, child):
        child.parent = self
        self.children.append(child)
        return child

    def get(self, name, default=None):
        return self.attrs.get(name, default)

    @property
    def classes(self):
        return (self.attrs.get("class") or "").split()

    def texts(self):
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if n.tag is None:
                out.append(n.text)
            elif n.tag != "#":
                stack.extend(reversed(n.children))
        return out

    def joined(self, sep=""):
        """Text of all descendants, trimmed."""
        return sep.join(self.texts()).strip()

    def elements(self):
        return [c for c in self.children if c.tag not in (None, "#")]

    def ancestors(self):
        n = self.parent
        while n is not None:
            yield n
            n = n.parent


def _attribute(value: str) -> str:
    def one(m):
        name, after = m[1], value[m.end() : m.end() + 1]
        if name[0] != "#" and not name.endswith(";") and (after == "=" or after.isalnum()):
            return m[0]
        return _html.unescape(m[0])

    return _ENTITY.sub(one, value) if "&" in value else value


@lru_cache(4096)
def _attributes(raw: str) -> tuple:
    found = {}
    for name, double, single, bare in _ATTR.findall(raw):
        name = name.lower()
        if name not in found:
            value = double or single or bare
            found[name] = _attribute(value) if "&" in value else value
    return tuple(found.items())


class Document:
    """A parsed page: ``root`` is the html element, ``all`` its elements in document order."""

    def __init__(self, text: str, fragment: bool = False):
        self.comments = 0
        self.root = Node("html", {})
        self.top = [self.root]
        self._stack, self._active = [self.root], []
        self._head = self._body = self._form = None
        self._text = text
        if fragment:
            self._body = self.root
        self._build(text)
        if not fragment:
            self._ensure_body()
        self._number()

    # construction

    def _build(self, text):
        at, n, search = 0, len(text), _TOKEN.search
        while at < n:
            m = search(text, at)
            if m is None:
                self._characters(text[at:])
                break
            start, end = m.span()
            if start > at:
                self._characters(text[at:start])
            at = end
            comment, close, tag, attrs, decl, rest = m.groups()
            if rest:
                break  # a tag that never ends is none
            if tag is not None:
                tag = tag.lower()
                if close:
                    last = self._stack[-1]
                    if last.tag == tag and tag not in _CLOSING and self._body is not None:
                        self._stack.pop()
                    else:
                        self._close(tag)
                else:
                    self._open(tag, dict(_attributes(attrs)) if attrs else {})
                    if tag in VERBATIM and self._stack[-1].tag == tag:
                        end = _END[tag].search(text, at)
                        raw = text[at : end.start()] if end else text[at:]
                        if tag in RCDATA:
                            raw = _html.unescape(raw)
                            if tag == "textarea" and raw.startswith("\n"):
                                raw = raw[1:]
                        if raw:
                            self._stack[-1].add(Node(None, text=raw))
                        self._stack.pop()
                        at = end.end() if end else n
            elif comment is not None:
                self._comment(comment)
            elif decl is not None and not decl[:7].lower() == "doctype":
                self._comment(decl)

    def _comment(self, text):
        self.comments += 1
        node = Node("#", text=text)
        if len(self._stack) == 1 and self._head is None and self._body is None:
            self.top.append(node)
            node.parent = None
        else:
            self._stack[-1].add(node)

    def _ensure_head(self):
        if self._head is None:
            self._head = self.root.add(Node("head", {}))

    def _ensure_body(self):
        if self._body is None:
            self._ensure_head()
            self._body = self.root.add(Node("body", {}))
            self._stack = [self.root, self._body]

    def _in_head(self):
        return self._body is None and len(self._stack) > 1 and self._stack[-1] is self._head

    def _characters(self, raw):
        text = _html.unescape(raw) if "&" in raw else raw
        if self._body is None and not text.strip(_SPACE):
            if self._in_head():
                self._put_text(text)
            return
        if self._body is None:
            self._ensure_body()
        if self._active and text.strip(_SPACE):
            self._reconstruct()
        self._put_text(text)

    def _put_text(self, text):
        parent = self._stack[-1]
        children = parent.children
        if children and children[-1].tag is None:
            children[-1].text += text
        else:
            node = Node(None, None, text)
            node.parent = parent
            children.append(node)

    def _has(self, tag, stop=SCOPE):
        for n in reversed(self._stack):
            if n.tag == tag:
                return True
            if n.tag in stop:
                return False
        return False

    def _pop_to(self, tag):
        while len(self._stack) > 1:
            if self._stack.pop().tag == tag:
                return

    def _reconstruct(self):
        for n in self._active:
            if n not in self._stack:
                break
        else:
            return
        for k, n in enumerate(self._active):
            if n not in self._stack and len(self._stack) < DEPTH:
                copy = self._stack[-1].add(Node(n.tag, n.attrs))
                self._stack.append(copy)
                self._active[k] = copy

    def _push(self, tag, attrs):
        stack = self._stack
        node = Node(tag, attrs)
        node.parent = parent = stack[-1]
        parent.children.append(node)
        if tag not in VOID and (len(stack) < DEPTH or tag in VERBATIM):
            stack.append(node)
        return node

    def _open(self, tag, attrs):
        if tag == "html":
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            return
        if self._body is None:
            if tag == "head":
                if self._head is None:
                    self._head = self.root.add(Node("head", attrs))
                    self._stack = [self.root, self._head]
                return
            if tag in HEAD:
                if self._head is None or self._stack[-1].tag == "html":
                    self._ensure_head()
                    self._stack = [self.root, self._head]
                self._push(tag, attrs)
                return
            self._ensure_head()
            self._body = self.root.add(Node("body", attrs if tag == "body" else {}))
            self._stack = [self.root, self._body]
            if tag == "body":
                return
        elif tag == "body" and self._body.tag == "body":
            for k, v in attrs.items():
                self._body.attrs.setdefault(k, v)
            return
        if tag == "head":
            return
        stack = self._stack
        if tag in CLOSES_P and self._has("p", P_SCOPE):
            self._pop_to("p")
        if tag not in _OWN:
            pass
        elif tag in HEADINGS:
            if stack[-1].tag in HEADINGS:
                stack.pop()
        elif tag == "li":
            self._implied(("li",), ("ul", "ol", "menu"))
        elif tag in ("dd", "dt"):
            self._implied(("dd", "dt"), ("dl",))
        elif tag in ("option", "optgroup"):
            if stack[-1].tag == "option":
                stack.pop()
            if tag == "optgroup" and stack[-1].tag == "optgroup":
                stack.pop()
        elif tag in ("tbody", "thead", "tfoot"):
            self._table(("tbody", "thead", "tfoot", "caption", "colgroup"))
        elif tag == "tr":
            self._table(("tr", "caption", "colgroup"))
            if stack[-1].tag == "table":
                self._push("tbody", {})
        elif tag in ("td", "th"):
            self._table(("td", "th", "caption", "colgroup"))
            if stack[-1].tag == "table":
                self._push("tbody", {})
            if stack[-1].tag in ("tbody", "thead", "tfoot"):
                self._push("tr", {})
            if stack[-1].tag != "tr":
                return
        elif tag == "caption" or tag == "colgroup":
            self._table(("caption", "colgroup"))
        elif tag == "form":
            if self._form is not None:
                return
            self._form = self._push("form", attrs)
            return
        elif tag == "button" and self._has("button"):
            self._pop_to("button")
        elif tag == "a":
            for n in self._active:
                if n.tag == "a":
                    if n in stack:
                        self._close("a")
                    self._active = [x for x in self._active if x is not n]
                    break
        if tag in FORMAT:
            if not self._active:
                self._active = [self._push(tag, attrs)]
                return
            self._reconstruct()
            alike = [n for n in self._active if n.tag == tag and n.attrs == attrs]
            drop = alike[0] if len(alike) == 3 else self._active[0] if len(self._active) == ACTIVE else None
            self._active = [n for n in self._active if n is not drop] + [self._push(tag, attrs)]
            return
        if self._active and (tag not in SPECIAL or tag in ("button", "object")):
            self._reconstruct()
        self._push(tag, attrs)

    def _implied(self, tags, stop):
        for n in reversed(self._stack):
            if n.tag in tags:
                self._pop_to(n.tag)
                return
            if n.tag in stop or n.tag in SCOPE or (n.tag in SPECIAL and n.tag not in ("address", "div", "p")):
                return

    def _table(self, tags):
        """Close open table parts up to where a new one of their kind belongs."""
        order = {"table": 0, "caption": 1, "colgroup": 1, "tbody": 1, "thead": 1, "tfoot": 1, "tr": 2, "td": 3, "th": 3}
        level = min(order[t] for t in tags if t not in ("caption", "colgroup")) if set(tags) - {"caption", "colgroup"} else 1
        depth = next((k for k in range(len(self._stack) - 1, -1, -1) if self._stack[k].tag == "table"), None)
        if depth is None:
            return
        cut = depth + 1
        while cut < len(self._stack) and order.get(self._stack[cut].tag, 9) < level and self._stack[cut].tag not in ("caption", "colgroup"):
            cut += 1
        del self._stack[cut:]

    def _close(self, tag):
        stack = self._stack
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self._in_head():
                stack.pop()
            return
        if self._body is None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            return
        if tag == "p" and not self._has("p", P_SCOPE):
            stack[-1].add(Node("p", {}))
            return
        if tag == "br":
            self._reconstruct()
            stack[-1].add(Node("br", {}))
            return
        if tag in HEADINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in HEADINGS:
                    del stack[k:]
                    return
                if stack[k].tag in SCOPE:
                    return
            return
        if tag == "form":
            self._form = None
        if tag in FORMAT:
            active = self._active
            if active and active[-1].tag == tag:
                active.pop()
            else:
                for n in reversed(active):
                    if n.tag == tag:
                        self._active = [x for x in active if x is not n]
                        break
        if len(stack) > 1 and stack[-1].tag == tag:
            del stack[-1]
            return
        stop = ("table", "html") if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else SCOPE
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                del stack[k:]
                return
            if stack[k].tag in stop and tag != stack[k].tag and tag not in SCOPE:
                return
            if tag not in SPECIAL and tag not in FORMAT and stack[k].tag in SPECIAL:
                return

    def _number(self):
        self.all, self.n_text, self.n_full_text = [], 0, 0
        self.by_tag: dict[str, list[Node]] = {}
        count, stack, every, by_tag = 0, [self.root], self.all, self.by_tag
        while stack:
            n = stack.pop()
            n.id = n.end = count
            count += 1
            tag = n.tag
            if tag is None:
                self.n_text += 1
                self.n_full_text += bool(n.text.strip())
            elif tag != "#":
                every.append(n)
                if tag in by_tag:
                    by_tag[tag].append(n)
                else:
                    by_tag[tag] = [n]
                if n.children:
                    stack += n.children[::-1]
        for n in reversed(every):
            if n.children:
                n.end = n.children[-1].end

    def free(self):
        """Take the tree apart: nodes and their parents refer to each other, and would otherwise wait for the garbage collector."""
        for n in self.all:
            n.children = ()

    # reading

    def select(self, css: str, within: Node | None = None) -> list[Node]:
        from .css import compile_css

        return compile_css(css)(self, within)

    def first(self, css: str, within: Node | None = None) -> Node | None:
        found = self.select(css, within)
        return found[0] if found else None

    def xpath(self, path: str) -> list:
        from .css import compile_xpath

        return compile_xpath(path)(self)

    @property
    def body(self):
        return self._body


def outer_html(node: Node) -> str:
    """A node serialised again."""
    if node.tag is None:
        raw = node.parent is not None and node.parent.tag in RAW
        return node.text if raw else node.text.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")
    if node.tag == "#":
        return f"<!--{node.text}-->"
    attrs = "".join(
        f' {k}="{v.replace("&", "&amp;").replace(chr(0xA0), "&nbsp;").replace(chr(34), "&quot;")}"' for k, v in node.attrs.items()
    )
    if node.tag in VOID:
        return f"<{node.tag}{attrs}>"
    return f"<{node.tag}{attrs}>{''.join(map(outer_html, node.children))}</{node.tag}>"
