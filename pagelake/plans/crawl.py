"""The crawl as level-synchronous breadth-first search over DataFrames.

A level is one plan: filters, an anti-join with what was visited, the fetch, detectors, link extraction. The
visited key is the URL as it stands; it is entered only once a response has passed all detectors, so failures may
be tried again by a later level. Within a level a URL is fetched once. Every level is written to the shared
folder, which cuts lineage and survives the loss of an executor.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import feed_type
from ..functions.responses import feed_links, is_html, is_xml, scrape_stats
from ..functions.urls import domain_allowed, url_allowed, url_host
from ..sources.fetch import default_headers, refusal, requests
from .config import CrawlConfig, LimitRule, SiteConfig
from .parse import elements, extract, selected_links, texts
from .ranking import row_numbers
from .shared import written


def matching_rule(hosts: DataFrame, rules: tuple[LimitRule, ...], host: str = "host") -> DataFrame:
    """``hosts`` with the number (and settings) of the first rule whose glob is found in the host; null without one."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        out = F.when(F.col(host).rlike(rule.pattern), F.lit(k)).otherwise(out)
    df = hosts.withColumn("rule_order", out)
    for name in ("parallelism", "delay_s", "random_delay_s"):
        value = F.lit(None)
        for k, rule in enumerate(rules):
            value = F.when(F.col("rule_order") == k, F.lit(getattr(rule, name))).otherwise(value)
        df = df.withColumn(name, value)
    return df


def schedule(urls: DataFrame, rules: tuple[LimitRule, ...], url: str = "url", order: str = "seq") -> DataFrame:
    """``urls`` with the second at which politeness lets each start: per host, batches of its rule's parallelism
    every delay. A host may hold any share of the rows.

    A random delay moves each start but the first by a share of it that follows from the URL, and never brings two batches
    closer than the delay."""
    queued = row_numbers(urls.withColumn("host", url_host(F.col(url))), "host", [order, url], "_turn")
    hosted, turn = matching_rule(queued, rules), F.col("_turn") - 1
    batch = F.floor(turn / F.greatest(F.coalesce("parallelism", F.lit(1)), F.lit(1)))
    delay, more = F.coalesce("delay_s", F.lit(0.0)), F.coalesce("random_delay_s", F.lit(0.0))
    share = F.pmod(F.xxhash64(F.col(url)), F.lit(1 << 20)) / float(1 << 20)
    start = batch * delay + F.when(batch > 0, more * (batch - 1 + share)).otherwise(0.0)
    return hosted.withColumn("start_s", F.when(F.col("rule_order").isNull(), 0.0).otherwise(start)).drop("_turn")


@dataclass
class Hooks:
    """Plug-in points; the last one set counts. Element hooks are kept by selector, several to one."""

    on_request: Callable[[DataFrame], DataFrame] | None = None
    on_response: Callable[[DataFrame], DataFrame] | None = None
    on_html: Callable[[DataFrame], None] | None = None
    on_error: Callable[[DataFrame], None] | None = None
    on_scraped: Callable[[DataFrame], None] | None = None
    bot_challenge: Callable[..., Column] | None = None
    access_denied: Callable[..., Column] | None = None
    element: dict[tuple[str, str], list[Callable[[DataFrame], None]]] = field(default_factory=dict)

    def on_element(self, selector: str, call: Callable[[DataFrame], None], kind: str = "css") -> None:
        self.element.setdefault((kind, selector), []).append(call)

    def detach(self, selector: str, kind: str = "css") -> None:
        self.element.pop((kind, selector), None)


class Crawler:
    """Fetches seeds and, if told to, what they link to, level by level."""

    def __init__(self, spark: SparkSession, fetcher, config: CrawlConfig = CrawlConfig(), hooks: Hooks | None = None, visited: DataFrame | None = None):
        self.spark, self.fetcher, self.config, self.hooks = spark, fetcher, config, hooks or Hooks()
        self.visited = visited

    def fresh(self) -> Crawler:
        """Same configuration, nothing visited, no hooks."""
        return Crawler(self.spark, self.fetcher, self.config)

    def with_config(self, **changes) -> Crawler:
        return Crawler(self.spark, self.fetcher, replace(self.config, **changes), self.hooks, self.visited)

    def allowed(self, url: Column) -> Column:
        c = self.config
        return url_allowed(url, c.allow, c.deny) & domain_allowed(url, c.allowed_domains, c.disallowed_domains)

    def _fetch(self, frontier: DataFrame) -> DataFrame:
        c, h = self.config, self.hooks
        sent = default_headers(frontier, dict(c.headers))
        if h.on_request:
            sent = h.on_request(sent)
        names = sent.columns
        if c.limits:
            # one task holds all of a host that a rule limits, earliest first; the fetcher waits until start_s
            sent = schedule(sent, c.limits, order="url")
            free = F.when(F.col("rule_order").isNull(), F.xxhash64("url"))
            sent = sent.repartition(F.coalesce("host", "url"), F.coalesce(free, F.lit(0).cast("long"))).sortWithinPartitions("start_s")
            sent = sent.select(*names, "start_s")
        fetcher = self.fetcher.limited(c.concurrency) if hasattr(self.fetcher, "limited") else self.fetcher
        got = fetcher.fetch(sent).drop("start_s") if c.limits else fetcher.fetch(sent)
        why = refusal(c.detect_bot_challenge, c.detect_access_denied, h.bot_challenge, h.access_denied)
        return got.withColumn("refused", why)

    def crawl(self, seeds: DataFrame, url: str = "url") -> DataFrame:
        """A row per fetched URL: depth, status, final_url, response columns, and ``refused`` with why it failed."""
        c, h = self.config, self.hooks
        frontier = requests(seeds.where(self.allowed(F.col(url))), url).dropDuplicates(["url"])
        done, depth = None, 0
        visited = self.visited
        while depth <= c.max_depth:
            frontier = frontier.where(self.allowed(F.col("url")))
            if visited is not None:
                seen = frontier.where("not allow_revisit").join(visited, "url", "left_anti")
                frontier = seen.unionByName(frontier.where("allow_revisit"))
            level = written(self._fetch(frontier), f"level{depth}")
            good = level.where("refused is null")
            for call, rows in ((h.on_error, level.where("refused is not null")), (h.on_html, good.where(self._html()))):
                if call:
                    call(rows)
            if h.on_response:
                good = h.on_response(good)
            for (kind, selector), calls in h.element.items():
                found = extract(good.where(self._html()), html="response_body", base="final_url", element=elements(selector, kind))
                rows = found.select("url", F.inline("element"))
                for call in calls:
                    call(rows)
            done = level if done is None else done.unionByName(level)
            fresh = good.select("url").distinct()
            visited = fresh if visited is None else visited.unionByName(fresh)
            if depth % 8 == 7:
                visited = written(visited, "visited")  # one table again, so that no plan reads a part for every level
            if not c.follow_links or depth == c.max_depth:
                break
            links = selected_links(c.link_selector, c.link_selector_type, absolute=True)
            found = extract(good.where(self._html()), html="response_body", base="final_url", _links=links)
            onward = found.select(F.explode("_links").alias("url")).distinct().where(self.allowed(F.col("url")))
            onward = written(onward.join(visited, "url", "left_anti"), f"frontier{depth + 1}")
            if onward.isEmpty():
                break
            depth += 1
            frontier = requests(onward).withColumn("depth", F.lit(depth))
        self.visited = visited
        if h.on_scraped:
            h.on_scraped(done.where("refused is null"))
        return done

    @staticmethod
    def _html() -> Column:
        return is_html(F.col("response_headers"), F.col("response_body"))

    def visit(self, url: str) -> DataFrame:
        """A single seed; one that filters reject gives no row and no error."""
        return self.crawl(self.spark.createDataFrame([(url,)], "url string"))

    def run_with_results(self, urls: list[str]) -> DataFrame:
        """seed_idx, url, status (success or failed) and error of every seed, filtered ones as success."""
        seeds = self.spark.createDataFrame(list(enumerate(urls)), "seed_idx int, url string")
        got = self.crawl(seeds.select("url")).where("depth = 0").select("url", "refused").dropDuplicates(["url"])
        return seeds.join(got, "url", "left").select(
            "seed_idx", "url", F.when(F.col("refused").isNull(), "success").otherwise("failed").alias("status"), F.col("refused").alias("error")
        ).orderBy("seed_idx")

    def get_links(self, urls: DataFrame, selector: str, kind: str = "css") -> DataFrame:
        """url and its absolute distinct links; no filters, detectors or visited set."""
        got = self.fetcher.fetch(requests(urls))
        if kind == "xpath":
            got = got.withColumn("_xml", is_xml(F.col("response_body")))
            found = extract(got, html="response_body", base="final_url", links=selected_links(selector, kind, absolute=True))
            return found.select("url", F.when(F.col("_xml"), feed_links(F.col("response_body"))).otherwise(F.col("links")).alias("links"), "error")
        found = extract(got, html="response_body", base="final_url", links=selected_links(selector, kind, absolute=True))
        return found.select("url", "links", "error")

    def get_feed_links(self, urls: DataFrame) -> DataFrame:
        """url, feed_type and links of feeds; JSON feeds are an error."""
        got = self.fetcher.fetch(requests(urls)).withColumn("feed_type", feed_type(F.col("response_body")))
        json = F.col("feed_type") == "json"
        return got.select(
            "url", "feed_type", F.when(~json, feed_links(F.col("response_body"))).alias("links"),
            F.when(json, "json feeds aren't supported").otherwise(F.col("error")).alias("error"),
        )

    def get_articles(self, urls: DataFrame) -> DataFrame:
        """url and its readable article."""
        got = self.fetcher.fetch(requests(urls))
        return extract(got, "article", html="response_body", base="final_url").select("url", "article", "error")


def scrape_sites(spark: SparkSession, fetcher, sites: list[SiteConfig], config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """Articles of the enabled sites: site_name, title, url, raw_html and content (text) of each page that a site's list links to."""
    out = None
    for site in sites:
        if not site.enabled:
            continue
        crawler = Crawler(spark, fetcher, config)
        seed = spark.createDataFrame([(site.url,)], "url string")
        found = crawler.get_links(seed, f"{site.list_selector} {site.link_selector}").select(F.explode("links").alias("url")).distinct()
        got = crawler.crawl(written(found, "articles")).where("refused is null")
        title, content = (extract(got, html="response_body", base="final_url", t=texts(x)) for x in (site.title_selector, site.content_selector))
        page = title.select("url", F.col("response_body").alias("raw_html"), F.get("t", F.lit(0)).alias("title"))
        body = content.select("url", F.array_join("t", "\n").alias("content"))
        rows = page.join(body, "url").select(F.lit(site.name).alias("site_name"), "title", "url", "raw_html", "content")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "site_name string, title string, url string, raw_html string, content string")
    return out


def stats(results: DataFrame, *by: str) -> DataFrame:
    """Totals of crawl results."""
    outcome = F.when(F.col("refused").isNull(), "success").otherwise("failed")
    return scrape_stats(results.withColumn("status", outcome), *by)
