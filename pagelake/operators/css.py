"""Selector subset: types, *, .class, #id, attribute tests, :first-child, :last-child, descendant, child, lists;
and the XPath subset //a/b, [@x='v'], /@attr, /text(). Compiled once per expression."""

from __future__ import annotations

import re
from functools import lru_cache

from .dom import Document, Node


class SelectorError(ValueError):
    """A selector that doesn't parse."""


_PART = re.compile(
    r"\s*(?P<comb>>|\+|~)?\s*(?P<body>(?:\*|[\w-]+)?(?:[.#][\w-]+|\[[^\]]*\]|:(?:first|last)-child)*)", re.UNICODE
)
_SIMPLE = re.compile(r"\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[^\]]*)\]|:(?P<pos>first|last)-child|(?P<tag>\*|[\w-]+)")
_ATTR = re.compile(r"""\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\s"'\]]+))\s*)?\Z""")


def _attr_test(raw):
    m = _ATTR.match(raw)
    if not m:
        raise SelectorError(raw)
    name, op = m[1].lower(), m[2]
    value = next((g for g in m.groups()[2:] if g is not None), "")
    if op is None:
        return lambda n: name in n.attrs
    if op == "=":
        return lambda n: n.attrs.get(name) == value
    if op == "~=":
        return lambda n: value in (n.attrs.get(name) or "").split()
    if op == "|=":
        return lambda n: (v := n.attrs.get(name)) is not None and (v == value or v.startswith(value + "-"))
    if not value:
        return lambda n: False
    test = {"^=": str.startswith, "$=": str.endswith, "*=": str.__contains__}[op]
    return lambda n: (v := n.attrs.get(name)) is not None and test(v, value)


def _compound(body):
    tests, tag = [], None
    at = 0
    while at < len(body):
        m = _SIMPLE.match(body, at)
        if not m:
            raise SelectorError(body)
        at = m.end()
        if m["tag"]:
            tag = None if m["tag"] == "*" else m["tag"].lower()
        elif m["cls"]:
            tests.append(lambda n, c=m["cls"]: c in (n.attrs.get("class") or "").split())
        elif m["id"]:
            tests.append(lambda n, i=m["id"]: n.attrs.get("id") == i)
        elif m["pos"]:
            k = 0 if m["pos"] == "first" else -1
            tests.append(lambda n, k=k: n.parent is None or n.parent.elements()[k] is n)
        else:
            tests.append(_attr_test(m["attr"]))

    def match(n):
        if tag is not None and n.tag != tag:
            return False
        for t in tests:
            if not t(n):
                return False
        return True

    return tag, match if tests or tag is None else None


def _complex(text):
    parts, at = [], 0
    text = text.strip()
    if not text:
        raise SelectorError("empty selector")
    while at < len(text):
        m = _PART.match(text, at)
        if not m or not m["body"] or m["comb"] in ("+", "~"):
            raise SelectorError(text)
        part_tag, match = _compound(m["body"])
        parts.append((m["comb"] or " ", part_tag, match or (lambda n, t=part_tag: n.tag == t)))
        at = m.end()
        if at == len(text) and len(parts) == 1 and parts[0][0] == " ":
            return part_tag, match
    tag, last = parts[-1][1:]

    def up(n, k):
        comb = parts[k][0]
        if k == 0:
            return comb == " "
        before = parts[k - 1][2]
        if comb == ">":
            return n.parent is not None and before(n.parent) and up(n.parent, k - 1)
        return any(before(a) and up(a, k - 1) for a in n.ancestors())

    return tag, lambda n: last(n) and up(n, len(parts) - 1)


def _split(text):
    return re.split(r",(?![^\[]*\])", text)


@lru_cache(1024)
def compile_css(text: str):
    """A function (document, within) -> elements in document order."""
    options = [_complex(t) for t in _split(text)]
    tagged = all(tag is not None for tag, _ in options)

    def select(doc: Document, within: Node | None = None):
        if tagged:
            found = []
            for tag, match in options:
                pool = doc.by_tag.get(tag, ())
                if within is not None:
                    pool = [n for n in pool if within.id < n.id <= within.end]
                found += pool if match is None else filter(match, pool)
            if len(options) > 1 and len(found) > 1:
                found = sorted({n.id: n for n in found}.values(), key=lambda n: n.id)
            return found
        pool = doc.all
        if within is not None:
            pool = [n for n in pool if within.id < n.id <= within.end]
        return [n for n in pool if any(n.tag == t if m is None else m(n) for t, m in options)]

    return select


_STEP = re.compile(r"(//?)(?:@([\w:-]+)|(text\(\))|(\*|[\w-]+)((?:\[[^\]]*\])*))")
_PRED = re.compile(r"""\[\s*(?:@([\w:-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'))?|([0-9]+)|contains\(\s*@([\w:-]+)\s*,\s*(?:"([^"]*)"|'([^']*)')\s*\))\s*\]""")


@lru_cache(256)
def compile_xpath(path: str):
    """A function document -> elements, or (element, attribute, value) triples, or texts."""
    steps, at = [], 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise SelectorError(path)
        preds, p = [], 0
        raw = m[5] or ""
        while p < len(raw):
            q = _PRED.match(raw, p)
            if not q:
                raise SelectorError(path)
            preds.append(q.groups())
            p = q.end()
        steps.append((m[1] == "//", m[2], bool(m[3]), m[4], preds))
        at = m.end()
    if not steps:
        raise SelectorError(path)

    def keep(nodes, preds):
        for name, dq, sq, index, part, pd, ps in preds:
            if index:
                nodes = nodes[int(index) - 1 : int(index)]
            elif part:
                want = pd if pd is not None else ps
                nodes = [n for n in nodes if want in n.attrs.get(part, "")]
            elif dq is None and sq is None:
                nodes = [n for n in nodes if name in n.attrs]
            else:
                nodes = [n for n in nodes if n.attrs.get(name) == (dq if dq is not None else sq)]
        return nodes

    def run(doc: Document):
        here = [None]
        for deep, attr, text, tag, preds in steps:
            found, seen = [], set()
            for n in here:
                if n is None:
                    pool = doc.all if deep else [doc.root]
                elif deep:
                    pool = [e for e in doc.all if n.id < e.id <= n.end]
                else:
                    pool = n.elements()
                if attr or text:
                    of = ([n] if n is not None else []) + (list(pool) if deep else [])
                    if attr:
                        found += [(e, attr, e.attrs[attr]) for e in of if attr in e.attrs]
                    else:
                        found += [c.text for e in of for c in e.children if c.tag is None]
                    continue
                for e in keep([e for e in pool if tag in ("*", e.tag)], preds):
                    if id(e) not in seen:
                        seen.add(id(e))
                        found.append(e)
            here = found
            if attr or text:
                return here
        return sorted(here, key=lambda e: e.id)

    return run
