"""Queries over accessors, branches and crawl calls that other queries don't reach: HTML is rendered from relational rows and the SQL is the plain relational query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import responses, text
from ..operators import selectors
from ..sources.fetch import CorpusFetcher
from . import records
from .config import CrawlConfig, LimitRule, MediaConfig, SiteConfig
from .crawl import Crawler, Hooks, scrape_sites
from .parse import elements, extract, first_text, media_feature, parse_pages, texts
from .queries_render import BASE, _forms_of, _grouped, _meta, _of, _order_links, _site, c
from .registry import cat, escaped, pages, query, spread, table

# pages as they are

_ENTITIES = "x"
for _name, _char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
    _ENTITIES = f"regexp_replace({_ENTITIES}, '&{_name};?', '{_char}', 'g')"
_DECODED = lambda sql: _ENTITIES.replace("regexp_replace(x,", f"regexp_replace({sql},")
_ARTICLE = "regexp_extract(html, '<article>(.*)</article>', 1, 's')"
_PIECES = lambda sql: f"list_filter(list_transform(regexp_split_to_array({sql}, '<[^>]*>'), lambda p: trim({_DECODED('p')}, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '')"


_CLEAN = lambda sql: rf"trim(regexp_replace({_DECODED(f'array_to_string(regexp_split_to_array({sql}, {chr(39)}<[^>]*>{chr(39)}), {chr(39)} {chr(39)})')}, '\s+', ' ', 'g'))"
_AD = "regexp_extract(html, '<div class=.ad.>(.*?)</div>', 1, 's')"


@query(
    rf"""WITH m AS (SELECT page_id, {_CLEAN(_ARTICLE)} AS main, {_CLEAN(_AD)} AS ad FROM pages),
a AS (SELECT page_id, CASE WHEN strlen(main) > 20 THEN main ELSE trim(ad || ' ' || main) END AS t FROM m),
w AS (SELECT page_id, unnest(string_split(t, ' ')) AS w FROM a),
n AS (SELECT page_id, count(*) FILTER (WHERE regexp_matches(w, '\pL')) AS words FROM w GROUP BY page_id)
SELECT page_id, t AS cleaned_text, words AS word_count, CAST(length(t) AS BIGINT) AS char_count, CASE WHEN words > 0 THEN round(words / 225.0::DOUBLE, 6) END AS reading_time_minutes
FROM a JOIN n USING (page_id)"""
)
def page_cleaned_text(spark, sf_dir):
    """The article's text, or if that is 20 bytes or less, that of the body without navigation and footer."""
    found = parse_pages(pages(spark, sf_dir)).select("page_id", "text.*")
    return found.select("page_id", "cleaned_text", "word_count", "char_count", F.round("reading_time_minutes", 6).alias("reading_time_minutes"))


@query(
    rf"""SELECT page_id, CAST(length(t) AS BIGINT) AS length, sha256(t) AS text_sha256 FROM (SELECT page_id, trim(array_to_string(list_filter(list_transform(
    regexp_split_to_array({_ARTICLE}, '<[^>]*>'), lambda p: {_DECODED('p')}), lambda p: p <> ''), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM pages)"""
)
def selected_text(spark, sf_dir):
    """Text nodes of the first match of a content selector."""
    found = extract(pages(spark, sf_dir), t=first_text("article"))
    return found.select("page_id", F.length("t").cast("long").alias("length"), F.sha2("t", 256).alias("text_sha256"))


@query(
    rf"""WITH p AS (SELECT page_id, {_PIECES("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title, {_PIECES("regexp_extract(html, '<nav>(.*?)</nav>', 1, 's')")} AS nav,
  {_PIECES("regexp_extract(html, '<div class=.ad.>(.*?)</div>', 1, 's')")} AS ad, {_PIECES(_ARTICLE)} AS main, {_PIECES("regexp_extract(html, '<footer>(.*?)</footer>', 1, 's')")} AS foot FROM pages),
l AS (SELECT page_id, list_sum(list_transform(title, lambda x: strlen(x))) AS title, list_sum(list_transform(nav, lambda x: strlen(x) + 1)) + 2 AS nav,
  list_sum(list_transform(ad, lambda x: strlen(x) + 1)) AS ad, list_sum(list_transform(main, lambda x: strlen(x) + 1)) AS main, list_sum(list_transform(foot, lambda x: strlen(x) + 1)) AS foot,
  len(title) + len(nav) + len(ad) + len(main) + len(foot) + 2 AS nodes FROM p)
SELECT page_id, CAST(title + nav + ad + main + 1 + foot AS BIGINT) AS text_length, CAST(CASE WHEN main > 50 THEN main ELSE nav + ad + main + 1 + foot END AS BIGINT) AS main_content_length, CAST(nodes AS BIGINT) AS text_node_count FROM l"""
)
def fingerprint_lengths(spark, sf_dir):
    """Texts of title, navigation, advertisement, article (the body instead, if it is short) and footer as the fingerprint joins them; style and script are two nodes more."""
    return extract(pages(spark, sf_dir), "fingerprint").select(
        "page_id", "fingerprint.text_length", "fingerprint.main_content_length", "fingerprint.text_node_count"
    )


@query(
    rf"""SELECT page_id, h AS heading, 1 AS level, n AS headings, strlen(h) AS selected FROM (SELECT page_id,
    trim({_DECODED("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) AS h, len(regexp_extract_all(html, '<h1>')) AS n FROM pages)"""
)
def page_headings(spark, sf_dir):
    found = extract(pages(spark, sf_dir), "main_heading", every=texts(selectors.headings()))
    h = F.col("main_heading")
    return found.select("page_id", h["text"].alias("heading"), h["level"].alias("level"), F.size("every").cast("long").alias("headings"), F.octet_length(c("every")[0]).alias("selected"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(replace(text, ' ', chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS folded FROM documents""")
def newline_folding(spark, sf_dir):
    t = F.replace(F.col("text"), F.lit(" "), F.lit("\n"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.collapse_newlines(t).alias("folded"))


# records


@query(
    """SELECT o_custkey, count(*) FILTER (WHERE k = 'internal') AS internal, count(*) FILTER (WHERE k <> 'internal') AS external, count(*) FILTER (WHERE r) AS followable FROM
    (SELECT o_custkey, CASE WHEN o_custkey % 4 = 2 THEN 'external' ELSE 'internal' END AS k, o_orderkey % 5 > 2 AS r FROM orders) GROUP BY o_custkey"""
)
def link_kinds(spark, sf_dir):
    found = extract(_order_links(spark, sf_dir), "links")
    return found.select("o_custkey", *(F.size(records.links_of(c("links"), k)).cast("long").alias(k) for k in ("internal", "external", "followable")))


@query(
    """SELECT o_orderkey, o_orderkey % 10 = 0 AS has_login, CAST(o_orderkey % 10 = 0 AS INT) AS login_forms, CASE WHEN o_orderkey % 3 = 0 THEN 'hidden' END AS token_type,
    CASE WHEN o_orderkey % 10 IN (0, 1, 9) THEN 'password' END AS secret_type, o_orderpriority AS note,
    1 + CAST(o_orderkey % 10 IN (0, 1, 9) AS INT) + CAST(o_orderkey % 3 = 0 AS INT) + CAST(o_orderkey % 4 = 0 AS INT) AS inputs, true AS has_forms FROM orders"""
)
def form_accessors(spark, sf_dir):
    found = extract(_forms_of(spark, sf_dir), "forms", "has_forms")
    form, named = c("forms")[0], records.field_named
    return found.select(
        "o_orderkey", records.has_form(c("forms"), "login").alias("has_login"), F.size(records.forms_of(c("forms"), "login")).alias("login_forms"),
        named(form, "_Csrf")["field_type"].alias("token_type"), named(form, "pw")["field_type"].alias("secret_type"), named(form, "t")["value"].alias("note"),
        F.size(F.filter(form["fields"], lambda f: f["field_type"].isin("email", "password", "hidden", "text"))).alias("inputs"), "has_forms",
    )


_STYLES = ("infinite_scroll", "load_more", "cursor", "offset", "numbered", "next_prev", "none")


@query(
    f"""SELECT p_partkey, [{', '.join(repr(s) for s in _STYLES)}][(p_partkey % 7) + 1] AS pagination_type, p_partkey % 7 = 0 AS scroll, p_partkey % 7 = 1 AS more,
    p_partkey % 7 IN (0, 1, 2, 3, 4) AS page_has, p_partkey % 7 <> 6 AS paginated,
    CASE p_partkey % 7 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 0 END AS urls FROM part"""
)
def pagination_kinds(spark, sf_dir):
    k = c("p_partkey")
    links = lambda a, b: cat('<div class="pagination"><a href="/l?', a, k, '">1</a><a href="/l?', b, k, '">2</a></div>')
    body = (
        F.when(k % 7 == 0, '<div class="infinite-scroll"></div>').when(k % 7 == 1, '<button class="load-more">Load more</button>')
        .when(k % 7 == 2, links("cursor=a", "cursor=b")).when(k % 7 == 3, links("offset=1", "offset=2")).when(k % 7 == 4, links("page=1", "page=2"))
        .when(k % 7 == 5, "<p>.</p><a href=/a>Previous</a><a href=/b>Next</a>").otherwise("<p>nothing here</p>")
    )
    found = extract(_of(spark, sf_dir, "part", cat("<body>", body), "p_partkey"), "pagination", "has_pagination")
    p = c("pagination")
    return found.select(
        "p_partkey", p["pagination_type"].alias("pagination_type"), p["has_infinite_scroll"].alias("scroll"), p["has_load_more"].alias("more"),
        c("has_pagination").alias("page_has"), records.paginated(p).alias("paginated"), F.size(p["page_urls"]).alias("urls"),
    )


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '/contact-us' END AS contact_page, s_suppkey % 3 <> 0 AS reachable, n_name AS city, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS postal_code,
    'State ' || s_nationkey AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def contact_facts(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "supplier")).join(table(spark, sf_dir, "nation"), c("s_nationkey") == c("n_nationkey"))
    k = c("s_suppkey")
    html = cat(
        "<title>x</title>", F.when(k % 2 == 0, "<a href='/contact-us'>write</a>").otherwise("<a href='/x'>y</a>"),
        F.when(k % 3 == 0, "").otherwise("<a href='https://github.com/pagelake-user'>code</a>"),
        "<address>Long Street\ncity: ", c("n_name"), "\nstate: State ", c("s_nationkey"), "\nzip ", F.lpad(k.cast("string"), 5, "0"), "\n</address>",
    )
    found = extract(rows.select("s_suppkey", html.alias("html")), "contacts", "contact_page", base=None)
    x = c("contacts")
    # postal codes may read as phone numbers, so reachable is asked without phones
    bare = x.withField("phones", F.filter(x["phones"], lambda p: F.lit(False)))
    place = x["addresses"][0]
    return found.select(
        "s_suppkey", "contact_page", records.has_contact_info(bare).alias("reachable"), place["city"].alias("city"), place["postal_code"].alias("postal_code"), place["state"].alias("state")
    )


@query(
    """SELECT s_suppkey, s_suppkey % 3 <> 0 AS has_feeds, CASE s_suppkey % 3 WHEN 1 THEN 'rss2' WHEN 2 THEN 'atom' END AS first_type,
    CASE WHEN s_suppkey % 3 = 1 THEN 'http://shop.example/f/' || s_suppkey END AS rss FROM supplier"""
)
def feed_facts(spark, sf_dir):
    k = c("s_suppkey")
    tag = lambda kind, path: cat(f'<link rel="alternate" type="application/{kind}+xml" href="/{path}/', k, '">')
    html = F.when(k % 3 == 1, tag("rss", "f")).when(k % 3 == 2, tag("atom", "a")).otherwise("<p>x</p>")
    found = extract(_of(spark, sf_dir, "supplier", html, "s_suppkey"), "feeds")
    return found.select(
        "s_suppkey", (F.size("feeds") > 0).alias("has_feeds"), records.first_feed(c("feeds"))["feed_type"].alias("first_type"),
        records.first_feed(c("feeds"), "rss", "rss2")["url"].alias("rss"),
    )


@query(
    """SELECT p_partkey, p_size::VARCHAR AS size, p_brand AS brand, 'replaced' AS twice FROM part"""
)
def custom_meta(spark, sf_dir):
    html = cat(_meta("x-size", c("p_size").cast("string")), _meta("x-brand", c("p_brand")), _meta("x-twice", F.lit("first")), _meta("x-twice", F.lit("replaced")))
    m = c("metadata")["custom"]
    found = extract(_of(spark, sf_dir, "part", html, "p_partkey"), "metadata")
    return found.select("p_partkey", m["x-size"].alias("size"), m["x-brand"].alias("brand"), m["x-twice"].alias("twice"))


@query(
    """SELECT p_partkey, p_partkey % 4 <> 3 AS has_media, p_partkey % 4 = 0 AS large, CAST(p_partkey % 4 = 0 AS INT) AS minimal_images, 0 AS minimal_videos,
    CAST(p_partkey % 4 = 1 AS INT) AS vimeo, CAST(p_partkey % 4 = 2 AS INT) AS pdfs,
    CASE p_partkey % 4 WHEN 0 THEN 'http://shop.example/i/' || p_partkey || '.png' WHEN 1 THEN 'https://player.vimeo.com/video/' || p_partkey WHEN 2 THEN 'http://shop.example/d/' || p_partkey || '.pdf' END AS url FROM part"""
)
def media_facts(spark, sf_dir):
    k = c("p_partkey")
    html = (
        F.when(k % 4 == 0, cat('<img src="/i/', k, '.png" width=300>')).when(k % 4 == 1, cat('<iframe src="https://player.vimeo.com/video/', k, '"></iframe>'))
        .when(k % 4 == 2, cat('<a href="/d/', k, '.pdf">d</a>')).otherwise("<p>text</p>")
    )
    found = extract(_of(spark, sf_dir, "part", html, "p_partkey"), "media", "has_media", small=media_feature(MediaConfig.minimal()))
    m, h = c("media"), c("has_media")
    wide = F.exists(m["images"], lambda i: i["width"] >= 300)
    return found.select(
        "p_partkey", F.greatest(*(h[n] for n in ("image", "video", "audio", "document", "embedded"))).alias("has_media"), wide.alias("large"),
        F.size(c("small")["images"]).alias("minimal_images"), F.size(c("small")["videos"]).alias("minimal_videos"),
        F.size(F.filter(m["videos"], lambda v: v["platform"] == "vimeo")).alias("vimeo"), F.size(records.documents_of(m["documents"], "pdf")).alias("pdfs"),
        F.try_element_at(records.media_urls(m), F.lit(1)).alias("url"),
    )


@query(
    """SELECT n_nationkey, '<html><head></head><body><p>' || replace(n_name, '&', '&amp;') || '</p><ul><li>a</li><li>b</li></ul></body></html>' AS again,
    n_name AS fragment_text, n_regionkey % 2 = 0 AS is_xml FROM nation"""
)
def html_again(spark, sf_dir):
    """Malformed markup as it is read, a fragment, and what counts as XML."""
    html = cat("<p>", escaped(c("n_name")), "<ul><li>a<li>b")
    rows = table(spark, sf_dir, "nation").select(
        "n_nationkey", html.alias("html"), F.when(c("n_regionkey") % 2 == 0, " <?xml version='1.0'?><rss>").otherwise("<html>").alias("said")
    )
    found = extract(rows, "html_again", base=None)
    found = extract(found, p=texts("p"), base=None, fragment=True)
    return found.select("n_nationkey", c("html_again").alias("again"), c("p")[0].alias("fragment_text"), responses.is_xml(c("said")).alias("is_xml"))


# the crawl


@query(
    """SELECT 'http://f.example/' || r_regionkey AS url, CASE WHEN r_regionkey = 4 THEN 'json' WHEN r_regionkey % 2 = 0 THEN 'rss2' ELSE 'atom' END AS feed_type,
    CASE WHEN r_regionkey <> 4 THEN (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) END AS links, CASE WHEN r_regionkey = 4 THEN 'json feeds aren''t supported' END AS error FROM region"""
)
def crawl_feeds(spark, sf_dir):
    key = c("n_regionkey")
    rss = cat("<item><link>http://n.example/", c("n_nationkey"), "</link></item>")
    atom = cat('<entry><link rel="x" href="http://n.example/', c("n_nationkey"), '"/></entry>')
    body = _grouped(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey", F.when(key % 2 == 0, rss).otherwise(atom))
    xml = (
        F.when(key == 4, '{"version":"https://jsonfeed.org/version/1","items":[]}').when(key % 2 == 0, cat('<rss version="2.0">', c("body"), "</rss>"))
        .otherwise(cat("<feed>", c("body"), "</feed>"))
    )
    site = body.select(cat("http://f.example/", key).alias("url"), xml.alias("html"))
    found = Crawler(spark, CorpusFetcher(site)).get_feed_links(site.select("url"))
    return found.select("url", "feed_type", F.size("links").cast("long").alias("links"), "error")


_STORY = "The quick brown fox of {} jumps over the lazy dog, and then it rests for a long while, because the day is warm and the grass is soft. "


@query(
    f"""SELECT 'http://a.example/' || s_suppkey AS url, s_name AS title, true AS has_story, NULL::VARCHAR AS error FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT 'http://a.example/' || s_suppkey, NULL, NULL, 'http: not found' FROM supplier WHERE s_suppkey % 2 = 1"""
)
def crawl_articles(spark, sf_dir):
    told = cat("<p>", _STORY.split("{}")[0], c("s_name"), _STORY.split("{}")[1] * 4, "</p>")
    html = cat("<title>", c("s_name"), "</title><article><h1>", c("s_name"), "</h1>", told, told, told, "</article>")
    url = cat("http://a.example/", c("s_suppkey"))
    every = table(spark, sf_dir, "supplier").select(url.alias("url"), html.alias("html"), "s_suppkey")
    found = Crawler(spark, CorpusFetcher(every.where("s_suppkey % 2 = 0").drop("s_suppkey"))).get_articles(every.select("url"))
    return found.select("url", c("article")["title"].alias("title"), c("article")["content"].contains("lazy dog").alias("has_story"), "error")


@query(
    """SELECT 'http://w.example/r/' || n_regionkey AS url, 'a' AS name, '/n/' || n_nationkey AS href, 'element' AS hook FROM nation WHERE n_regionkey <> 3
    UNION ALL SELECT 'http://w.example/n/' || c_nationkey, 'a', '/c/' || c_custkey, 'element' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 3
    UNION ALL SELECT DISTINCT 'http://w.example/n/' || n_nationkey, NULL, NULL, 'error' FROM nation WHERE n_regionkey <> 3 AND n_nationkey NOT IN (SELECT c_nationkey FROM customer)
    UNION ALL SELECT DISTINCT 'http://w.example/r/' || n_regionkey, NULL, NULL, 'html' FROM nation WHERE n_regionkey <> 3
    UNION ALL SELECT DISTINCT 'http://w.example/n/' || c_nationkey, NULL, NULL, 'html' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 3"""
)
def crawl_hooks(spark, sf_dir):
    """What hooks see: the request hook aborts region 3, element hooks get links, others whole pages or failures."""
    site, region = _site(spark, sf_dir)
    seen = []

    def note(kind, name=F.lit(None).cast("string"), href=F.lit(None).cast("string")):
        return lambda rows: seen.append(rows.select("url", name.alias("name"), href.alias("href"), F.lit(kind).alias("hook")))

    hooks = Hooks(on_request=lambda df: df.withColumn("aborted", c("aborted") | c("url").endswith("/r/3")), on_html=note("html"), on_error=note("error"))
    hooks.on_element("a[href]", note("element", c("name"), c("attrs")["href"]))
    hooks.on_element("b", note("element"))
    hooks.detach("b")
    Crawler(spark, CorpusFetcher(site), CrawlConfig(follow_links=True, max_depth=1), hooks).crawl(region.select(cat("http://w.example/r/", c("r_regionkey")).alias("url")))
    out = seen[0]
    for rows in seen[1:]:
        out = out.unionByName(rows)
    return out


@query(
    """SELECT 'http://w.example/n/' || c_nationkey AS url, count(*) AS pages FROM customer GROUP BY c_nationkey"""
)
def crawl_politely(spark, sf_dir):
    """A crawl under limits finds what one without them finds."""
    site, _ = _site(spark, sf_dir)
    asked = table(spark, sf_dir, "customer").select(cat("http://w.example/n/", c("c_nationkey")).alias("url")).distinct()
    limits = (LimitRule("w.example", 2, 5.0, 1.0),)
    found = Crawler(spark, CorpusFetcher(site), CrawlConfig(limits=limits)).crawl(asked).where("refused is null")
    links = extract(found, html="response_body", base=None, a=texts("a"))
    return links.select("url", F.size("a").cast("long").alias("pages"))


@query("""SELECT 'shop' AS site_name, s_name AS title, 'http://t.example/' || s_suppkey AS url, s_name || ' sells' AS content FROM supplier""")
def scraped_articles(spark, sf_dir):
    k = c("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    leaf = rows.select(cat("http://t.example/", k).alias("url"), cat("<h1>", escaped(c("s_name")), "</h1><article>", escaped(c("s_name")), " sells</article>").alias("html"))
    top = _grouped(rows.withColumn("all", F.lit("http://t.example/")), ["all"], "s_suppkey", cat('<a href="/', k, '">x</a>'))
    site = leaf.unionByName(top.select(c("all").alias("url"), cat("<div id=list>", c("body"), "</div><a href='/no'>n</a>").alias("html")))
    sites = [SiteConfig("shop", "http://t.example/", "#list"), SiteConfig("off", "http://u.example/", enabled=False)]
    return scrape_sites(spark, CorpusFetcher(site), sites).drop("raw_html")


@query(
    """SELECT p_partkey, 'http://shop.example/x' || p_partkey AS first, 2 AS n, kind FROM part, (VALUES ('css'), ('xpath')) AS v(kind)"""
)
def element_kinds(spark, sf_dir):
    html = cat("<div><a class=k href='/x", c("p_partkey"), "'>1</a><a class=k href='/y'>2</a></div>")
    rows = _of(spark, sf_dir, "part", html, "p_partkey")
    found = extract(rows, css=elements("a.k"), xpath=elements("//a[@class='k']", "xpath"))
    pick = lambda k: F.struct(F.concat(F.lit("http://shop.example"), c(k)[0]["attrs"]["href"]).alias("first"), F.size(k).alias("n"), F.lit(k).alias("kind"))
    return found.select("p_partkey", F.inline(F.array(pick("css"), pick("xpath"))))
