"""Builders of selector strings; values are taken as they are."""

from __future__ import annotations

from .css import SelectorError, compile_css


def attr(name: str) -> str:
    return f"[{name}]"


def attr_contains(name: str, value: str) -> str:
    return f'[{name}*="{value}"]'


def attr_starts_with(name: str, value: str) -> str:
    return f'[{name}^="{value}"]'


def class_(name: str) -> str:
    return "." + name


def id_(name: str) -> str:
    return "#" + name


def descendant(ancestor: str, inner: str) -> str:
    return f"{ancestor} {inner}"


def child(parent: str, inner: str) -> str:
    return f"{parent} > {inner}"


def multi(*selectors: str) -> str:
    return ", ".join(selectors)


def headings() -> str:
    return multi(*(f"h{k}" for k in range(1, 7)))


def meta_name(name: str) -> str:
    return f'meta[name="{name}"]'


def meta_property(name: str) -> str:
    return f'meta[property="{name}"]'


def link_rel(rel: str) -> str:
    return f'link[rel="{rel}"]'


def try_compile(text: str):
    """The compiled selector, or None if it doesn't parse."""
    try:
        return compile_css(text)
    except SelectorError:
        return None
