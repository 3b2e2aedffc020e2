"""URL resolution as browsers do it (the part that http and https pages need), one function with the choices
that callers differ in."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import quote

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_AUTHORITY = re.compile(r"(?:([^@]*)@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?\Z")
_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
_PATH_SAFE = "!$%&'()*+,-./:;=@[]^_|~\\"
_QUERY_SAFE = "!$%&()*+,-./:;=?@[]\\^_`{|}~"
_BAD_HOST = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|]")


class Url:
    __slots__ = ("fragment", "host", "path", "port", "query", "scheme", "user")

    def __init__(self, scheme, user, host, port, path, query, fragment):
        self.scheme, self.user, self.host, self.port = scheme, user, host, port
        self.path, self.query, self.fragment = path, query, fragment

    def text(self, fragment=True):
        out = self.scheme + ":"
        if self.host is not None:
            out += "//" + (f"{self.user}@" if self.user else "") + self.host + (f":{self.port}" if self.port else "")
        out += self.path
        if self.query is not None:
            out += "?" + self.query
        if fragment and self.fragment is not None:
            out += "#" + self.fragment
        return out


def _dots(path: str) -> str:
    if path.startswith("/") and "/." not in path and "%2" not in path:
        return path
    out = []
    parts = path.split("/")[1:]
    for k, p in enumerate(parts):
        low = p.lower().replace("%2e", ".")
        if low == "..":
            if out:
                out.pop()
            if k == len(parts) - 1:
                out.append("")
        elif low == ".":
            if k == len(parts) - 1:
                out.append("")
        else:
            out.append(p)
    return "/" + "/".join(out)


def _split(rest: str):
    if "#" not in rest and "?" not in rest:
        return rest, None, None
    rest, hash_, fragment = rest.partition("#")
    rest, mark, query = rest.partition("?")
    return rest, quote(query, safe=_QUERY_SAFE) if mark else None, quote(fragment, safe=_QUERY_SAFE + "'#") if hash_ else None


@lru_cache(8192)
def _host(raw: str) -> str | None:
    if raw.startswith("["):
        return raw.lower()
    host = raw.lower()
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    return None if not host or _BAD_HOST.search(host) else host


_CONTROLS = "".join(map(chr, range(33)))
_BREAKS = str.maketrans("", "", "\t\n\r")


def _clean(text: str) -> str:
    text = text.strip(_CONTROLS)
    return text if text.isprintable() else text.translate(_BREAKS)


@lru_cache(8192)
def parse_url(text: str | None, base: Url | None = None) -> Url | None:
    """The URL a text names, against a base; None where it isn't one."""
    if text is None:
        return None
    text = _clean(text)
    m = _SCHEME.match(text)
    if m and not (base is not None and m[1].lower() == base.scheme and m[1].lower() in _PORTS and not text[m.end() :].startswith(("/", "\\"))):
        scheme, rest = m[1].lower(), text[m.end() :]
        if scheme not in _PORTS:
            path, query, fragment = _split(rest)
            return Url(scheme, None, None, None, path, query, fragment)
        return _special(scheme, rest.lstrip("/\\"))
    if m:
        text = text[m.end() :]
    if base is None or base.host is None:
        return None
    path, query, fragment = _split(text)
    path = path.replace("\\", "/")
    if path.startswith("//"):
        return _special(base.scheme, text.lstrip("/\\"))
    keep = (base.scheme, base.user, base.host, base.port)
    if not path:
        return Url(*keep, base.path, query if query is not None else base.query, fragment)
    if not path.startswith("/"):
        path = base.path[: base.path.rfind("/") + 1] + path
    return Url(*keep, _dots(quote(path, safe=_PATH_SAFE).replace("\\", "/")), query, fragment)


_AFTER = re.compile(r"[/?#\\]")


def _special(scheme, rest):
    m = _AFTER.search(rest)
    authority, rest = (rest[: m.start()], rest[m.start() :]) if m else (rest, "")
    a = _AUTHORITY.match(authority)
    host = _host(a[2]) if a else None
    if host is None or (a[3] and int(a[3]) > 65535):
        return None
    port = str(int(a[3])) if a[3] else None
    path, query, fragment = _split(rest)
    path = _dots(quote(path.replace("\\", "/") or "/", safe=_PATH_SAFE))
    return Url(scheme, a[1] or None, host, None if port == _PORTS[scheme] else port, path, query, fragment)


def resolve(
    href: str | None,
    base: Url | None,
    *,
    verbatim_absolute: bool = False,
    slashes: str | None = "base",
    without_base: str | None = None,
    skip: tuple[str, ...] = (),
    trim: bool = True,
    http_only: bool = False,
    keep_data: bool = False,
) -> str | None:
    """An absolute URL, or None.

    verbatim_absolute: http(s) links aren't re-serialised. slashes: scheme given to //host links ("base", "https",
    or None to join them like any other). without_base: "verbatim" returns relative links as they are if there
    is no base. skip: prefixes that give None, as the empty link does. keep_data: data: links stay as they are.
    """
    if href is None:
        return None
    if trim:
        href = href.strip()
        if not href:
            return None
    if skip and href.startswith(skip):
        return None
    if slashes and href.startswith("//"):
        scheme = base.scheme if slashes == "base" and base is not None else "https"
        return f"{scheme}:{href}"
    if keep_data and href.startswith("data:"):
        return href
    if href.startswith(("http://", "https://")):
        if verbatim_absolute:
            return href
        url = parse_url(href)
        return url.text() if url else None
    if base is None:
        return href if without_base == "verbatim" else None
    url = parse_url(href, base)
    if url is None or (http_only and url.scheme not in ("http", "https")):
        return None
    return url.text()


def normalise(text: str | None) -> str | None:
    """Re-serialised without fragment and default port; other schemes stay; None if it isn't a URL."""
    url = parse_url(text)
    if url is None:
        return None
    return url.text(fragment=False) if url.scheme in ("http", "https") else text


def host(text: str | None) -> str | None:
    url = parse_url(text)
    return url.host if url else None
