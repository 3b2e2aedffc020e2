"""Predicates over responses (status INT, headers MAP, body STRING) as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_success(status: Column) -> Column:
    return (status >= 200) & (status < 300)


def content_type(headers: Column) -> Column:
    return F.try_element_at(headers, F.lit("content-type"))


def _lower(body: Column) -> Column:
    """ASCII letters only."""
    return F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_html(headers: Column, body: Column) -> Column:
    said = _lower(F.coalesce(content_type(headers), F.lit("")))
    typed = said.contains("text/html") | said.contains("application/xhtml+xml")
    return typed | F.coalesce(body, F.lit("")).rlike(r"(?i)^\s*<(?:!doctype html|html)")


def _any(text, *words):
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _all(text, *words):
    out = F.lit(True)
    for w in words:
        out = out & text.contains(w)
    return out


def challenge_vendor(body: Column) -> Column:
    """Which of six groups of marks a page shows, null if none."""
    b = _lower(body)
    return (
        F.when(_any(b, "humansecurity.com", "px-captcha", "pxcaptcha", "px-cloud.net", "_pxhd", "_pxuuid", "_pxappappid"), "perimeterx")
        .when(_any(b, "challenge-platform", "cf-challenge") | _all(b, "cloudflare", "enable javascript", "ray id"), "cloudflare")
        .when(_any(b, "captcha-delivery", "datadome"), "datadome")
        .when(_all(b, "akamai") & _any(b, "challenge", "bot"), "akamai")
        .when(_all(b, "denied", "access to this page") & _any(b, "verify you are", "press & hold", "human", "captcha"), "interstitial")
        .when(
            _all(b, "challenge", "<title>")
            & _any(b, "blocked", "robot", "security check", "please verify", "access denied", "attention required"),
            "titled",
        )
    )


def is_bot_challenge(status: Column, headers: Column, body: Column) -> Column:
    return F.coalesce((status == 200) & is_html(headers, body) & challenge_vendor(body).isNotNull(), F.lit(False))


def is_access_denied(status: Column, headers: Column, body: Column) -> Column:
    b, size = _lower(body), F.octet_length(body)
    permission, denied = b.contains("you don't have permission"), b.contains("access denied")
    edge = _any(b, "edgekey.net", "edgesuite.net") & (permission | denied)
    reference = (size < 5000) & b.contains("reference #") & _any(b, "errors.edgekey.net", "errors.edgesuite.net")
    cloud = (status == 403) & b.contains("cloudflare") & _any(b, "error 1020", "denied")
    short = (size < 3000) & (status == 403) & (permission | denied | _any(b, "not allowed", "403 forbidden"))
    found = (status >= 400) & (status < 500) & is_html(headers, body) & (edge | reference | cloud | short)
    return F.coalesce(found, F.lit(False))


def is_xml(body: Column) -> Column:
    return F.coalesce(body, F.lit("")).rlike(r"^\s*<(?:\?xml|rss|feed|sitemap|urlset)")


def feed_links(xml: Column) -> Column:
    """http(s) links of a feed: texts of link elements, then href attributes, distinct."""
    texts = F.transform(F.regexp_extract_all(xml, F.lit(r"<link>\s*(https?:[/]{2}[^<]*?[^<\s])\s*</link>"), F.lit(1)), lambda x: F.trim(x))
    hrefs = F.transform(F.regexp_extract_all(xml, F.lit(r'<link[^>]{1,}href="(https?:[/]{2}[^"]+)"'), F.lit(1)), lambda x: F.trim(x))
    return F.array_distinct(F.concat(texts, hrefs))


def scrape_stats(results, *by: str):
    """total, success, failed, skipped and success_rate of rows with a ``status`` of success, failed or skipped."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.groupBy(*by).agg(
        F.count("*").alias("total"), n("success").alias("success"), n("failed").alias("failed"), n("skipped").alias("skipped"),
        F.coalesce(F.try_divide(n("success").cast("double"), F.count("*")), F.lit(0.0)).alias("success_rate"),
    )
