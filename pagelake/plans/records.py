"""Filters, accessors and aggregates over extracted records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_host

OFFICE = ("excel", "powerpoint", "word")
SOCIAL = ("facebook", "instagram", "linkedin", "pinterest", "reddit", "tiktok", "twitter")
CODE = ("codepen", "codesandbox", "jsfiddle")


def followable(link: Column) -> Column:
    rel = link["rel"]
    return ~(F.array_contains(rel, "no_follow") | F.array_contains(rel, "sponsored") | F.array_contains(rel, "ugc"))


def links_of(links: Column, kind: str) -> Column:
    """internal, external or followable links."""
    return F.filter(links, followable if kind == "followable" else lambda x: x["link_type"] == kind)


def external_domains(links: Column) -> Column:
    hosts = F.transform(links_of(links, "external"), lambda x: url_host(x["url"]))
    return F.array_sort(F.array_distinct(F.filter(hosts, lambda h: h.isNotNull())))


def link_stats(links: Column) -> Column:
    """Counts of a page's links."""
    count = lambda test: F.size(F.filter(links, test)).cast("long")
    domains = external_domains(links)
    return F.struct(
        F.size(links).cast("long").alias("total"), count(lambda x: x["link_type"] == "internal").alias("internal"),
        count(lambda x: x["link_type"] == "external").alias("external"), count(lambda x: x["is_nofollow"]).alias("nofollow"),
        count(lambda x: F.array_contains(x["rel"], "sponsored")).alias("sponsored"),
        count(lambda x: F.array_contains(x["rel"], "ugc")).alias("ugc"), count(followable).alias("followable"),
        F.size(domains).cast("long").alias("unique_external_domains"), domains.alias("external_domains"),
    )


def effective(meta: Column) -> Column:
    """Title, description and image with their fallbacks, and the indexing flags."""
    og, tw = meta["opengraph"], meta["twitter"]
    return F.struct(
        F.coalesce(og["title"], tw["title"], meta["title"]).alias("title"),
        F.coalesce(og["description"], tw["description"], meta["description"]).alias("description"),
        F.coalesce(og["image"], tw["image"]).alias("image"), meta["robots"]["index"].alias("should_index"),
        meta["robots"]["follow"].alias("should_follow"),
    )


def forms_of(forms: Column, kind: str) -> Column:
    return F.filter(forms, lambda f: f["form_type"] == kind)


def has_form(forms: Column, kind: str) -> Column:
    return F.exists(forms, lambda f: f["form_type"] == kind)


def visible_fields(form: Column) -> Column:
    return F.filter(form["fields"], lambda f: f["field_type"] != "hidden")


def input_fields(form: Column) -> Column:
    from ..operators.forms import INPUTS

    return F.filter(form["fields"], lambda f: f["field_type"].isin(*sorted(INPUTS)))


def field_named(form: Column, name: str) -> Column:
    return F.try_element_at(F.filter(form["fields"], lambda f: f["name"] == name), F.lit(1))


def numbered_pages(p: Column) -> Column:
    """Page URLs that aren't also a next, previous, first or last link."""
    nav = F.array(p["prev_url"], p["next_url"], p["first_url"], p["last_url"])
    return F.filter(p["page_urls"], lambda u: ~F.coalesce(F.array_contains(F.filter(nav, lambda n: n.isNotNull()), u["url"]), F.lit(False)))


def paginated(p: Column) -> Column:
    return (
        (p["pagination_type"] != "none") | (F.size(p["page_urls"]) > 1) | p["next_url"].isNotNull()
        | p["has_infinite_scroll"] | p["has_load_more"]
    )


def has_contact_info(c: Column) -> Column:
    return (F.size(c["emails"]) > 0) | (F.size(c["phones"]) > 0) | (F.size(c["social_links"]) > 0)


def feeds_of(feeds: Column, *kinds: str) -> Column:
    return F.filter(feeds, lambda f: f["feed_type"].isin(*kinds))


def first_feed(feeds: Column, *kinds: str) -> Column:
    return F.try_element_at(feeds_of(feeds, *kinds) if kinds else feeds, F.lit(1))


def amp_url(amp: Column) -> Column:
    return F.when(amp["is_amp"], amp["canonical_url"]).otherwise(amp["amp_url"])


def media_counts(media: Column) -> Column:
    names = ("images", "videos", "audio", "documents", "embeds")
    sizes = {n: F.size(media[n]).cast("long") for n in names}
    total = F.size(media["links"]).cast("long")
    for s in sizes.values():
        total = total + s
    return F.struct(*(s.alias(n) for n, s in sizes.items()), total.alias("total"))


def media_urls(media: Column, *kinds: str) -> Column:
    """Absolute URLs of images, videos, audio, documents and embeds, in this order."""
    kinds = kinds or ("images", "videos", "audio", "documents", "embeds")
    parts = [F.transform(media[k], lambda x: x["absolute_url"]) for k in kinds]
    return F.filter(F.concat(*parts), lambda u: u.isNotNull())


def best_image(image: Column) -> Column:
    """Widest source, else the densest, else the image; the last of equals."""

    def best(key):
        sized = F.filter(image["srcset"], lambda e: e[key].isNotNull())
        ranked = F.transform(sized, lambda e, k: F.struct(e[key].alias("v"), k.alias("k"), e["url"].alias("url")))
        return F.array_max(ranked)["url"]

    return F.coalesce(best("width"), best("density"), image["absolute_url"], image["src"])


def documents_of(docs: Column, *kinds: str) -> Column:
    return F.filter(docs, lambda d: d["doc_type"].isin(*kinds))


def embeds_of(embeds: Column, *platforms: str) -> Column:
    return F.filter(embeds, lambda e: e["platform"].isin(*platforms))


def corpus_rollup(rows: DataFrame, *by: str, count: str = "n", **aggregates: Column) -> DataFrame:
    """Counts and further aggregates of rows by every prefix of the keys."""
    return rows.rollup(*by).agg(F.count("*").alias(count), *(c.alias(n) for n, c in aggregates.items()))


def version_changes(prints: DataFrame, key: str = "url", order: str = "version", fingerprint: str = "fingerprint") -> DataFrame:
    """Each version of a page with what changed since the one before."""
    from pyspark.sql import Window

    from ..functions.kinds import fingerprint_change

    before = F.lag(fingerprint).over(Window.partitionBy(key).orderBy(order))
    found = prints.withColumn("_before", before).where(F.col("_before").isNotNull())
    return found.withColumn("change", fingerprint_change(F.col("_before"), F.col(fingerprint))).drop("_before")
