"""URL predicates and parts as native expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.config import UrlRule, valid_patterns

#: paths that articles have, and that they don't have
INCLUDE = (
    "/[0-9]{4}/[0-9]{2}/", r"\.(?:aspx?|cfm|s?html|htm|php)(?:\?|$)", "/[ap]/[0-9]+",
    "(?i)/(?:analysis|archives|articles?|commentary|content|detail|document|download|events?|highlights?|media)/",
    "(?i)/(?:news-events|node|opa|profiles|releases?|research|show|statuses|story|video)/",
    "(?i)/(?:blog|briefing|hearing|news|post|press|publication|report)",
)
EXCLUDE = (
    r"\.(?:css|dmg|exe|gif|ico|jpe?g|js|json|mp3|mp4|pdf|png|rar|rss|svg|webp|xml|zip)$",
    "(?i)/(?:author|category|categories|login|logout|page|register|search|tags?|wp-content|wp-includes)/",
    "(?:tel|mailto|javascript):", "#comment",
)
DEFAULT_RULE = UrlRule(include=INCLUDE, exclude=EXCLUDE)


def any_match(text: Column, patterns) -> Column:
    """Whether one of the patterns is found, as a single alternation per case-sensitivity."""
    plain = [p for p in patterns if not p.startswith("(?i)")]
    folded = [p[4:] for p in patterns if p.startswith("(?i)")]
    out = F.lit(False)
    if plain:
        out = out | text.rlike("|".join(f"(?:{p})" for p in plain))
    if folded:
        out = out | text.rlike("(?i)" + "|".join(f"(?:{p})" for p in folded))
    return out


def is_article_url(url: Column, rule: UrlRule = DEFAULT_RULE) -> Column:
    return ~any_match(url, rule.exclude) & any_match(url, rule.include)


def url_host(url: Column) -> Column:
    """Lower-cased host, without user and port; null if there is none."""
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.lower(F.nullif(raw, F.lit("")))


def url_allowed(url: Column, allow=(), deny=()) -> Column:
    """Deny patterns win; with allow patterns one must match. Patterns that don't compile are ignored."""
    allow, deny = valid_patterns(allow), valid_patterns(deny)
    out = ~any_match(url, deny) if deny else F.lit(True)
    return out & any_match(url, allow) if allow else out


def _in_domains(host: Column, domains) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | (host == d.lower()) | host.endswith("." + d.lower())
    return out


def domain_allowed(url: Column, allowed=(), disallowed=()) -> Column:
    """Host equals or lies below a listed domain; disallowed ones win; a URL without a host passes."""
    host = url_host(url)
    ok = ~_in_domains(host, disallowed) & (_in_domains(host, allowed) if allowed else F.lit(True))
    return F.when(host.isNull(), True).otherwise(ok)


def is_downloadable(url: Column) -> Column:
    return url.rlike("(?i)^https?://")


def page_number(url: Column) -> Column:
    """Page number from the query, /page/N, a loose page=N or page/N, or a trailing /N; beyond 32 bits it doesn't count."""
    patterns = (r"(?i)[?&](?:pg|page|p)=([0-9]+)", r"(?i)/page/([0-9]+)", r"(?i)(?:pg|page|p)[=/]([0-9]+)", r"/([0-9]+)/?$")
    number = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit("")).try_cast("decimal(38,0)")
    return F.coalesce(*(F.when(number(p) < (1 << 32), number(p)).cast("long") for p in patterns))


def page_url(url: Column, number: Column) -> Column:
    """The URL with another page number: in the query, else after /page/, else appended as a parameter."""
    n = number.cast("string")
    query, path = r"(?i)([?&](?:pg|page|p)=)[0-9]+", r"(?i)(/page/)[0-9]+/?"
    swapped = lambda p: F.concat(
        F.substring(url, F.lit(1), F.regexp_instr(url, F.lit(p)) + F.length(F.regexp_extract(url, p, 1)) - 1), n,
        F.substring(url, F.regexp_instr(url, F.lit(p)) + F.length(F.regexp_extract(url, p, 0)), F.length(url)),
    )
    bare, tail = F.regexp_extract(url, r"^[^#]*", 0), F.regexp_extract(url, r"#.*$", 0)
    mark = F.when(bare.rlike(r"\?$"), "").when(bare.contains("?"), "&").otherwise("?")
    return F.when(url.rlike(query), swapped(query)).when(url.rlike(path), swapped(path)).otherwise(
        F.concat(bare, mark, F.lit("page="), n, tail)
    )


def page_info(text: Column) -> Column:
    """Struct (current, pages, items) of texts such as "Page 2 of 9"."""
    both = r"(?i)(?:page|pg?)\s*([0-9]+)\s*(?:/|of)\s*([0-9]+)"
    get = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit("")).try_cast("long")
    items = get(r"(?i)(?:of|total|共)\s*([0-9]+)\s*(?:items?|results?|个|条|页)?[个条]?[\x{4e00}-\x{9fff}]*\s*$", 1)
    found = text.rlike(both)
    return F.struct(
        F.when(found, get(both, 1)).otherwise(get(r"(?i)(?:page|pg?)\s*([0-9]+)", 1)).alias("current"),
        F.when(found, get(both, 2)).alias("pages"), F.when(~found, items).alias("items"),
    )


def link_type(url: Column, base: Column) -> Column:
    """internal (same host, or below it), external or unknown."""
    host, of = url_host(url), url_host(base)
    scheme = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return (
        F.when(url.isNull() | ~scheme, "unknown").when(base.isNull(), "external").when(host.isNull(), "internal")
        .when(of.isNull(), "external").when((host == of) | host.endswith(F.concat(F.lit("."), of)), "internal").otherwise("external")
    )


def filename(url: Column) -> Column:
    """A safe file name: last path segment, odd characters as _; without one download_ and part of a hash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.element_at(F.split(path, "/"), -1)
    hashed = F.concat(F.lit("download_"), F.substring(F.sha2(url, 256), 1, 12))
    return F.when(F.coalesce(last, F.lit("")) == "", hashed).otherwise(F.regexp_replace(last, r"[^\p{IsAlphabetic}\p{N}._-]", "_"))


def _urls(fn, ddl="string"):
    """A Python URL routine over whole Arrow columns, each distinct pair computed once per batch."""

    @F.arrow_udf(T._parse_datatype_string(ddl) if not isinstance(ddl, T.DataType) else ddl)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        known: dict = {}
        out = []
        for pair in zip(a.to_pylist(), b.to_pylist()):
            if pair not in known:
                known[pair] = fn(*pair)
            out.append(known[pair])
        return pa.array(out, pa.string())

    return run


def resolve_url(href: Column, base: Column, **options) -> Column:
    """Absolute URL of a link (see url_join.resolve for the choices)."""
    from .url_join import parse_url, resolve

    return _urls(lambda h, b: resolve(h, parse_url(b), **options), T.StringType())(href, base)


def normalise_url(url: Column) -> Column:
    from .url_join import normalise

    return _urls(lambda u, _: normalise(u), T.StringType())(url, url)
