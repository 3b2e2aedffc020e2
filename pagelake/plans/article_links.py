"""Scored article links: cluster sizes by a window, scores as one expression, best row per URL by an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import DEFAULT_RULE, is_article_url
from .config import ExtractorConfig, UrlRule
from .parse import Feature, extract

NAV_WORDS = tuple("更多 登录 首页 subscribe previous prev next more login home".split()) + ("sign in", "sign up")


def candidates(pages: DataFrame, key: str = "page_id", html: str = "html", base: str = "url", depth: int = 4) -> DataFrame:
    """(key, pos, url, text, path, href, host, base_host), a row per usable link of each page."""
    from ..operators import links

    read = Feature(lambda d, b: links.link_candidates(d, b, depth), links.CANDIDATES)
    found = extract(pages.select(key, html, base), html=html, base=base, links=read)
    return found.select(key, F.inline("links"))


def link_score(cluster: Column, config: ExtractorConfig = ExtractorConfig(), rule: UrlRule = DEFAULT_RULE) -> Column:
    """Score of a candidate row whose path cluster has ``cluster`` members, as a DOUBLE in tenths."""
    url, text, href = F.col("url"), F.col("text"), F.col("href")
    n, low = F.char_length(text), F.lower(text)
    length = F.when(n >= config.min_text_len, F.when(n <= 120, 15).otherwise(10)).when(n == 0, -5).otherwise(0)
    group = F.when(cluster >= config.cluster_min_size, 15).when(cluster >= 2, 5).otherwise(0)
    segments = F.size(F.filter(F.slice(F.split(url, "/"), 4, 1 << 20), lambda s: s != ""))
    tenths = length + group + F.when(segments >= 2, 3).otherwise(-10)
    if config.use_url_rule:
        tenths += F.when(is_article_url(url, rule), 5).otherwise(0)
    tenths += F.when(low.isin(*NAV_WORDS), -15).otherwise(0)
    tenths += F.when(href.contains("?page=") | href.contains("&page="), -20).otherwise(0)
    tenths += F.when(text.rlike("^[0-9]+$"), -15).otherwise(0)
    tenths += F.when(F.col("host").isNotNull() & (F.col("host") != F.coalesce("base_host", F.lit(""))), -20).otherwise(0)
    off = F.lit(False)
    for p in config.non_article_paths:
        off = off | url.contains(p)
    tenths += F.when(off, -20).otherwise(0)
    return tenths.cast("double") / 10


def article_links(
    pages: DataFrame, config: ExtractorConfig = ExtractorConfig(), rule: UrlRule = DEFAULT_RULE, key: str = "page_id", **columns
) -> DataFrame:
    """(key, url, text, score, cluster_size): links of each page that score at least the threshold.

    Both the window and the aggregate work per page, so one shuffle by page serves both.
    """
    found = candidates(pages, key, depth=config.cluster_depth, **columns).repartition(key)
    sized = found.withColumn("cluster", F.count("*").over(Window.partitionBy(key, "path")))
    scored = sized.withColumn("score", link_score(F.col("cluster"), config, rule))
    best = scored.groupBy(key, "url").agg(
        F.max_by("text", F.struct(F.char_length("text"), -F.col("pos"))).alias("text"),
        F.max("score").alias("score"), F.max("cluster").alias("cluster_size"),
    )
    return best.where(F.col("score") >= config.score_threshold)
