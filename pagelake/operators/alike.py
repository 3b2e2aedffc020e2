"""Pages that differ only in numbers: read once, the others' records by putting their own numbers in.

This holds for records that no digit can change but by standing in a copied value: what is read compares values for equality or with words
without digits. A page is read with a mark of its own for each distinct number (equal numbers, equal marks), so all comparisons come out as
they do for the numbers. Digits that mean something where they stand (tag names, lengths of fields) stay, and are part of what must be equal;
pages with digits in character references are read one by one.
"""

from __future__ import annotations

import re
from typing import Any, Callable

_NUMBER = re.compile("([0-9]+)")
_FIRST, _MARK, MOST = 0xE000, "\ue000", 500
_MARKS = re.compile("([\ue000-\uf8ff])")
#: Where digits stay: names of tags, and anything from a length attribute up to the end of its tag.
_KEPT = re.compile(r"</?[A-Za-z][^\s/>]*+|(?:minlength|maxlength)[^>]*+", re.IGNORECASE)
_REFERENCE = re.compile("&[A-Za-z]*\ue000|&#")
#: Characters of the kinds of pages and of the templates that a reader keeps at a time.
KNOWN = 4_000_000


def _filler(value) -> Callable[[list], Any] | None:
    """What makes a value from a page's numbers; None if they don't occur in it."""
    if isinstance(value, str):
        parts = _MARKS.split(value)
        if len(parts) == 1:
            return None
        at = [ord(p) - _FIRST for p in parts[1::2]]
        if len(at) == 1:
            before, k, after = parts[0], at[0], parts[2]
            return lambda v: before + v[k] + after
        form = "%s".join(p.replace("%", "%%") for p in parts[::2])
        return lambda v: form % tuple([v[k] for k in at])
    if isinstance(value, (dict, list)):
        keys = value if isinstance(value, dict) else range(len(value))
        fillers = [(k, f) for k in keys if (f := _filler(value[k]))]
        if not fillers:
            return None

        def fill(v):
            out = value.copy()
            for k, f in fillers:
                out[k] = f(v)
            return out

        return fill
    return None


class Alike:
    """``read`` (a function of a page's text that gives dicts, lists, strings and the like) with templates for pages that come again with other numbers."""

    def __init__(self, read: Callable[[str], Any]):
        self.read = read
        self.kinds: dict[str, tuple | None] = {}
        self.templates: dict[tuple, tuple] = {}
        self.held = 0

    def _hold(self, text: str) -> None:
        self.held += len(text)
        if self.held > KNOWN:
            self.kinds.clear()
            self.templates.clear()
            self.held = len(text)

    def _kept(self, pieces: list[str]) -> tuple | None:
        """Which numbers stay, by place; None if such pages are read one by one."""
        text = _MARK.join(pieces)
        if _REFERENCE.search(text):
            return None
        kept, count, at = [], 0, 0
        for m in _KEPT.finditer(text):
            count += text.count(_MARK, at, m.start())
            at = m.end()
            inside = text.count(_MARK, m.start(), at)
            kept += range(count, count + inside)
            count += inside
        return tuple(kept)

    def __call__(self, text: str):
        pieces = _NUMBER.split(text)
        numbers = pieces[1::2]
        if not 0 < len(numbers) <= MOST or _MARKS.search(text):
            return self.read(text)
        kind = _MARK.join(pieces[::2])
        if kind not in self.kinds:
            self._hold(text)
            # the first of its kind may stay the only one
            self.kinds[kind] = self._kept(pieces[::2])
            return self.read(text)
        kept = self.kinds[kind]
        if kept is None:
            return self.read(text)
        places: dict[str, int] = {}
        alike = tuple([places.setdefault(n, len(places)) for n in numbers])
        key = (kind, alike, *[numbers[k] for k in kept])
        found = self.templates.get(key)
        if found is None:
            self._hold(text)
            marked = pieces.copy()
            for k, place in enumerate(alike):
                if k not in kept:
                    marked[2 * k + 1] = chr(_FIRST + place)
            record = self.read("".join(marked))
            found = self.templates[key] = (record, _filler(record))
        record, fill = found
        return record if fill is None else fill(list(places))
