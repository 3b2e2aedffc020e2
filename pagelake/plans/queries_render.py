"""Queries that render HTML from relational rows and read it back: the SQL is the plain relational query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kinds
from . import records
from .config import CrawlConfig
from .crawl import Crawler, Hooks, stats
from .parse import attributes, children, elements, extract, media_feature, selected_links, texts
from .config import MediaConfig
from .registry import RENDERED, cat, escaped, query, spread, table
from .shared import written

c = F.col
BASE = "http://shop.example/a/b"


def _of(spark, sf_dir, name, html, *keep, base=BASE):
    """Rows of a table with a page each."""
    return spread(table(spark, sf_dir, name), RENDERED).select(*keep, html.alias("html"), F.lit(base).alias("url"))


def _meta(name, value, attr="name"):
    return cat(f'<meta {attr}="{name}" content="', escaped(value), '">')


def _grouped(df, keys, order, html):
    """One page per key from the rows' snippets, in order; on a stated number of partitions, since pages are parsed next and small ones would be merged."""
    rows = F.array_sort(F.collect_list(F.struct(c(order).alias("k"), html.alias("h"))))
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys).groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["h"]), "").alias("body"))


# metadata


@query(
    """SELECT p_partkey, p_name AS title, p_type AS description, p_brand AS author, 'http://shop.example/p/' || p_partkey AS canonical,
    len(string_split(p_name, ' ')) AS keywords, '2024-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS published_date,
    CASE WHEN p_partkey % 2 = 0 THEN 'http://shop.example/i' || (p_size + 16) || '.png' ELSE 'http://shop.example/fav.ico' END AS favicon,
    p_partkey % 3 <> 0 AS index, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE -1 END AS max_snippet, p_brand AS effective_title FROM part"""
)
def page_metadata(spark, sf_dir):
    k = c("p_partkey")
    icon = F.when(k % 2 == 0, cat('<link rel="icon" sizes="', c("p_size") + 16, "x8\" href='/i", c("p_size") + 16, ".png'>")).otherwise("")
    robots = F.when(k % 3 == 0, cat('<meta name="robots" content="noindex, Max-Snippet:', c("p_size"), '">')).otherwise("")
    html = cat(
        "<html lang=en><head><title>", escaped(c("p_name")), "</title>", _meta("description", c("p_type")), _meta("author", c("p_brand"), "property"),
        _meta("keywords", F.replace(c("p_name"), F.lit(" "), F.lit(", ,"))), '<link rel="canonical" href="/p/', k, '">',
        '<meta name="date" content="2024-01-', F.lpad((c("p_size") % 28 + 1).cast("string"), 2, "0"), '"><link rel="icon" href="/fav.ico">', icon,
        robots, '</head><body><h1>no</h1></body></html>',
    )
    found = extract(_of(spark, sf_dir, "part", html, "p_partkey"), "metadata")
    m = c("metadata")
    return found.select(
        "p_partkey", m["title"].alias("title"), m["description"].alias("description"), m["author"].alias("author"), m["canonical"].alias("canonical"),
        F.size(m["keywords"]).cast("long").alias("keywords"), m["published_date"].alias("published_date"), m["favicon"].alias("favicon"),
        m["robots"]["index"].alias("index"), m["robots"]["max_snippet"].alias("max_snippet"),
        F.coalesce(m["opengraph"]["title"], m["author"]).alias("effective_title"),
    )


@query(
    """SELECT p_partkey, p_name AS title, 'http://x/' || p_partkey AS image, p_brand AS site_name, CAST(p_size AS VARCHAR) AS extra,
    'summary' AS card, p_type AS twitter_description, '@' || p_size AS creator, p_name AS effective_title, p_type AS effective_description FROM part"""
)
def opengraph_twitter(spark, sf_dir):
    html = cat(
        _meta("og:title", c("p_name"), "property"), _meta("og:image", cat("http://x/", c("p_partkey")), "property"),
        _meta("og:site_name", c("p_brand"), "property"), _meta("og:price", c("p_size").cast("string"), "property"),
        '<meta name="twitter:card" content=" summary ">', _meta("twitter:description", c("p_type")), _meta("twitter:creator", cat("@", c("p_size"))),
    )
    m = c("metadata")
    found = extract(_of(spark, sf_dir, "part", html, "p_partkey"), "metadata").withColumn("e", records.effective(m))
    return found.select(
        "p_partkey", m["opengraph"]["title"].alias("title"), m["opengraph"]["image"].alias("image"), m["opengraph"]["site_name"].alias("site_name"),
        m["opengraph"]["extra"]["og:price"].alias("extra"), m["twitter"]["card"].alias("card"),
        m["twitter"]["description"].alias("twitter_description"), m["twitter"]["creator"].alias("creator"),
        c("e.title").alias("effective_title"), c("e.description").alias("effective_description"),
    )


@query(
    """SELECT r_name AS region, lower(substr(n_name, 1, 2)) AS hreflang, 'http://shop.example/' || n_nationkey AS href FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def alternates(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), c("n_regionkey") == c("r_regionkey"))
    tag = cat('<link rel="alternate" hreflang="', F.lower(F.substring("n_name", 1, 2)), '" href="/', c("n_nationkey"), '">')
    found = extract(_grouped(rows, ["r_name"], "n_nationkey", tag).withColumn("url", F.lit(BASE)), "metadata", html="body")
    return found.select(c("r_name").alias("region"), F.inline("metadata.alternates"))


@query(
    """SELECT c_custkey, 'Person' AS schema_type, c_name AS name, c_acctbal AS balance, 'microdata' AS second, c_mktsegment AS segment FROM customer"""
)
def structured_data(spark, sf_dir):
    body = F.to_json(F.struct(F.lit("Person").alias("@type"), c("c_name").alias("name"), c("c_acctbal").alias("balance")))
    html = cat(
        '<script type="application/ld+json">', body, '</script><div itemscope itemtype="http://schema.org/Offer"><b itemprop="segment">',
        escaped(c("c_mktsegment")), '</b><i itemscope itemprop="inner">x</i></div>',
    )
    s = c("structured_data")
    found = extract(_of(spark, sf_dir, "customer", html, "c_custkey"), "structured_data")
    return found.select(
        "c_custkey", s[0]["schema_type"].alias("schema_type"), F.get_json_object(s[0]["raw"], "$.name").alias("name"),
        s[0]["properties"]["balance"].cast("double").alias("balance"), s[1]["format"].alias("second"),
        F.replace(s[1]["properties"]["segment"], F.lit('"'), F.lit("")).alias("segment"),
    )


# content


@query(
    """SELECT r_regionkey AS page, 1 AS level, r_name AS text, 0 AS depth FROM region
    UNION ALL SELECT n_regionkey, 2, n_name, 1 FROM nation
    UNION ALL SELECT n_regionkey, 3, 'about ' || n_name, CASE WHEN n_nationkey = m THEN 2 ELSE 2 END FROM nation JOIN (SELECT n_regionkey AS r, max(n_nationkey) AS m FROM nation GROUP BY 1) ON n_regionkey = r"""
)
def headings_outline(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), c("n_regionkey") == c("r_regionkey"))
    part = cat("<h2 class='x y'>", c("n_name"), "</h2><p>t<h3> about ", c("n_name"), "</h3>")
    body = _grouped(rows, ["r_regionkey", "r_name"], "n_nationkey", part)
    found = extract(body.withColumn("html", cat("<h1>", c("r_name"), "</h1>", c("body"))), "outline", "main_heading", base=None)
    return found.select(c("r_regionkey").alias("page"), F.inline("outline")).select("page", "level", "text", "depth")


@query(
    """SELECT c_custkey, count(*) AS paragraphs, CAST(sum(length(t)) AS BIGINT) AS letters FROM (SELECT c_custkey, unnest([c_name || ' of ' || c_mktsegment || ' & sons', c_mktsegment]) AS t FROM customer)
    WHERE strlen(t) >= 20 GROUP BY c_custkey"""
)
def paragraphs(spark, sf_dir):
    html = cat("<p>", c("c_name"), " of ", c("c_mktsegment"), " &amp; sons<p> ", c("c_mktsegment"), " </p>")
    found = extract(_of(spark, sf_dir, "customer", html, "c_custkey"), "paragraphs").select("c_custkey", F.explode("paragraphs").alias("t"))
    return found.groupBy("c_custkey").agg(F.count("*").alias("paragraphs"), F.sum(F.length("t")).alias("letters"))


@query(
    """SELECT 'unordered' AS list_type, r_name AS text, 0 AS level FROM region UNION ALL SELECT 'unordered', n_name, 1 FROM nation
    UNION ALL SELECT 'definition', r_name || ': ' || n_name, 0 FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def lists(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), c("n_regionkey") == c("r_regionkey"))
    items = _grouped(rows, ["r_regionkey", "r_name"], "n_nationkey", cat("<li>", c("n_name")))
    terms = _grouped(rows, ["r_regionkey", "r_name"], "n_nationkey", cat("<dd> ", c("n_name")))
    html = cat("<ul><li>", c("r_name"), "<ol>", c("i"), "</ol></ul><dl><dt>", c("r_name"), c("d"), "</dl>")
    both = items.withColumnRenamed("body", "i").join(terms.withColumnRenamed("body", "d"), ["r_regionkey", "r_name"])
    found = extract(both.select(html.alias("html")), "lists", base=None).select(F.inline("lists"))
    return found.select("list_type", "text", "level")


@query(
    """SELECT r_name AS caption, n_name AS nation, n_nationkey AS key, 2 AS colspan, 3::BIGINT AS column_count, true AS has_header FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def tables(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), c("n_regionkey") == c("r_regionkey"))
    row = cat("<tr><td colspan=2>", escaped(c("n_name")), "<td>", c("n_nationkey"))
    body = _grouped(rows, ["r_name"], "n_nationkey", row)
    html = cat("<table><caption>", c("r_name"), "</caption><thead><tr><th>a<th>b<th>c</thead>", c("body"), "</table>")
    found = extract(body.select(html.alias("html")), "tables", base=None).select(F.inline("tables"))
    flat = found.select("caption", "column_count", c("headers")[0]["is_header_row"].alias("has_header"), F.explode("rows").alias("r"))
    cell = lambda k, f: c("r.cells")[k][f]
    return flat.select(
        "caption", cell(0, "content").alias("nation"), cell(1, "content").cast("int").alias("key"), cell(0, "colspan").alias("colspan"),
        "column_count", "has_header",
    )


@query(
    """SELECT s_suppkey, language, is_inline, 'let x = ' || s_suppkey AS code, CASE WHEN is_inline THEN 1 ELSE 2 END::BIGINT AS line_count, filename FROM supplier,
    (VALUES ('rust', false, 'main.rs'), (NULL, true, NULL)) AS v(language, is_inline, filename)"""
)
def code_blocks(spark, sf_dir):
    code = cat("let x = ", c("s_suppkey"))
    html = cat('<pre><code class="hl language-rust" data-filename="main.rs">', code, "\n//</code></pre><p><code> ", code, "</code><pre>plain</pre>")
    found = extract(_of(spark, sf_dir, "supplier", html, "s_suppkey"), "code_blocks").select("s_suppkey", F.inline("code_blocks"))
    return found.select("s_suppkey", "language", "is_inline", F.split("code", "\n")[0].alias("code"), "line_count", "filename")


@query(
    """SELECT s_suppkey, s_name || ' says so — ' || n_name AS text, 'http://q/' || s_suppkey AS cite, n_name AS cite_url FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def quotes(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "supplier")).join(table(spark, sf_dir, "nation"), c("s_nationkey") == c("n_nationkey"))
    html = cat('<blockquote cite="http://q/', c("s_suppkey"), '">', c("s_name"), " says so &mdash; <cite>", c("n_name"), "</cite></blockquote><blockquote>x</blockquote>")
    return extract(rows.select("s_suppkey", html.alias("html")), "quotes", base=None).select("s_suppkey", F.inline("quotes"))


@query(
    """SELECT p_partkey, 'http://shop.example/a/img/' || p_partkey || '.png' AS url, p_name AS alt, p_size AS width, p_partkey % 2 = 0 AS lazy, false AS is_decorative FROM part"""
)
def images(spark, sf_dir):
    lazy = F.when(c("p_partkey") % 2 == 0, ' loading="lazy"').otherwise("")
    html = cat('<img src="img/', c("p_partkey"), '.png" alt="', escaped(c("p_name")), '" width=', c("p_size"), lazy, '><img src="data:x"><img>')
    found = extract(_of(spark, sf_dir, "part", html, "p_partkey"), "images").select("p_partkey", F.inline("images"))
    return found.select("p_partkey", "url", "alt", "width", (c("loading") == "lazy").alias("lazy"), "is_decorative")


# links

_SITES = "CASE o_custkey % 4 WHEN 0 THEN 'http://shop.example/o/' WHEN 1 THEN 'http://sub.shop.example/o/' WHEN 2 THEN 'http://other' || (o_custkey % 10) || '.example/o/' ELSE 'http://shop.example/a/' END || o_orderkey"
_KIND = "CASE WHEN o_custkey % 4 = 2 THEN 'external' ELSE 'internal' END"
_RELS = "CASE o_orderkey % 5 WHEN 0 THEN 'no_follow' WHEN 1 THEN 'sponsored' WHEN 2 THEN 'ugc' ELSE '' END"


def _order_links(spark, sf_dir):
    n = c("o_custkey") % 4
    k = c("o_orderkey")
    href = F.when(n == 0, cat("/o/", k)).when(n == 1, cat("HTTP://sub.Shop.example:80/o/", k, "#x")).when(
        n == 2, cat("//other", c("o_custkey") % 10, ".example/o/", k)
    ).otherwise(k.cast("string"))
    rel = F.when(k % 5 == 0, ' rel="NoFollow noopener"').when(k % 5 == 1, " rel=sponsored").when(k % 5 == 2, " rel='ugc'").otherwise("")
    tag = cat('<a href=" ', href, '"', rel, "><b>order</b> ", k, "</a><a href='#x'>n</a><a href='tel:1'>t</a>")
    rows = table(spark, sf_dir, "orders")
    return _grouped(rows, ["o_custkey"], "o_orderkey", tag).select("o_custkey", c("body").alias("html"), F.lit(BASE).alias("url"))


@query(f"SELECT o_custkey, {_SITES} AS url, 'order  ' || o_orderkey AS text, {_KIND} AS link_type, {_RELS} AS rel FROM orders")
def links(spark, sf_dir):
    found = extract(_order_links(spark, sf_dir), "links").select("o_custkey", F.inline("links"))
    rel = F.coalesce(F.when(F.size("rel") > 0, c("rel")[0]), F.lit(""))
    return found.select("o_custkey", "url", "text", "link_type", rel.alias("rel"))


@query(
    f"""SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE k = 'internal') AS internal, count(*) FILTER (WHERE k = 'external') AS external,
    count(*) FILTER (WHERE r = 'no_follow') AS nofollow, count(*) FILTER (WHERE r = 'sponsored') AS sponsored, count(*) FILTER (WHERE r = 'ugc') AS ugc,
    count(*) FILTER (WHERE r = '') AS followable, count(DISTINCT CASE WHEN k = 'external' THEN h END) AS unique_external_domains,
    coalesce(string_agg(DISTINCT CASE WHEN k = 'external' THEN h END, ' '), '') AS external_domains
    FROM (SELECT o_custkey, {_KIND} AS k, {_RELS} AS r, 'other' || (o_custkey % 10) || '.example' AS h FROM orders) GROUP BY o_custkey"""
)
def link_stats(spark, sf_dir):
    found = extract(_order_links(spark, sf_dir), "links").withColumn("s", records.link_stats(c("links")))
    names = ("total", "internal", "external", "nofollow", "sponsored", "ugc", "followable", "unique_external_domains")
    return found.select("o_custkey", *(f"s.{n}" for n in names), F.array_join("s.external_domains", " ").alias("external_domains"))


# forms

_ACTIONS = "login register search upload contact-us subscribe checkout comment other reset-password".split()
_ACTION_SQL = "[" + ", ".join(f"'{a}'" for a in _ACTIONS) + "][(o_orderkey % 10) + 1]"


def _forms_of(spark, sf_dir):
    k = c("o_orderkey")
    action = F.element_at(F.array(*map(F.lit, _ACTIONS)), (k % 10 + 1).cast("int"))
    secret = F.when((k % 10).isin(0, 1, 9), '<input type=password name=pw>').otherwise("")
    token = F.when(k % 3 == 0, '<input type=hidden name="_Csrf" value=1>').otherwise("")
    robot = F.when(k % 4 == 0, '<input name="g-recaptcha-response">').otherwise("")
    html = cat(
        '<form id=f method=POST action="/', action, '"><label for=m>Mail &amp; more</label><input id=m type=EMAIL name=m', k,
        " required minlength=3><label>Kind <select name=kind id=kk><option value=1>one<option value=2 selected></select></label>", secret, token, robot,
        "<textarea name=t> ", escaped(c("o_orderpriority")), " </textarea><button type=submit> Go </button></form>",
    )
    return _of(spark, sf_dir, "orders", html, "o_orderkey")


def _forms(spark, sf_dir):
    return extract(_forms_of(spark, sf_dir), "forms").select("o_orderkey", F.inline("forms"))


@query(
    f"""SELECT o_orderkey, 'post' AS method, CASE o_orderkey % 10 WHEN 0 THEN 'login' WHEN 1 THEN 'registration' WHEN 2 THEN 'search' WHEN 3 THEN 'upload'
    WHEN 4 THEN 'contact' WHEN 5 THEN 'newsletter' WHEN 6 THEN 'checkout' WHEN 7 THEN 'comment' WHEN 9 THEN 'password_reset' ELSE 'unknown' END AS form_type,
    o_orderkey % 3 = 0 AS has_csrf, o_orderkey % 4 = 0 AS has_captcha, 'Go' AS submit_text,
    3 + CAST(o_orderkey % 10 IN (0, 1, 9) AS INT) + CAST(o_orderkey % 4 = 0 AS INT) AS visible, '/' || {_ACTION_SQL} AS action FROM orders"""
)
def forms(spark, sf_dir):
    visible = F.size(F.filter("fields", lambda f: f["field_type"] != "hidden"))
    return _forms(spark, sf_dir).select(
        "o_orderkey", "method", "form_type", "has_csrf", "has_captcha", "submit_text", visible.alias("visible"), "action"
    )


@query(
    """SELECT o_orderkey, 'm' || o_orderkey AS name, 'email' AS field_type, 'Mail & more' AS label, true AS required, 3::BIGINT AS min_length, NULL::VARCHAR AS value, 0 AS options FROM orders
    UNION ALL SELECT o_orderkey, 'kind', 'select', 'Kind  one', false, NULL, NULL, 2 FROM orders
    UNION ALL SELECT o_orderkey, 't', 'textarea', NULL, false, NULL, o_orderpriority, 0 FROM orders
    UNION ALL SELECT o_orderkey, 'pw', 'password', NULL, false, NULL, NULL, 0 FROM orders WHERE o_orderkey % 10 IN (0, 1, 9)
    UNION ALL SELECT o_orderkey, '_Csrf', 'hidden', NULL, false, NULL, '1', 0 FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT o_orderkey, 'g-recaptcha-response', 'text', NULL, false, NULL, NULL, 0 FROM orders WHERE o_orderkey % 4 = 0"""
)
def form_fields(spark, sf_dir):
    found = _forms(spark, sf_dir).select("o_orderkey", F.inline("fields"))
    return found.select("o_orderkey", "name", "field_type", "label", "required", "min_length", "value", F.size("options").alias("options"))


# pagination


@query(
    """SELECT c_custkey, n + 2 AS current_page, 'numbered' AS pagination_type, 'http://shop.example/l?page=' || (n + 3) AS next_url,
    'http://shop.example/l?page=' || (n + 1) AS prev_url, 4::BIGINT AS pages, CASE WHEN c_custkey % 3 = 0 THEN n + 9 END AS total_pages, c_custkey % 2 = 0 AS has_next
    FROM (SELECT c_custkey, CAST(c_custkey % 50 AS INT) AS n FROM customer)"""
)
def pagination(spark, sf_dir):
    n = c("c_custkey") % 50
    link = lambda k, mark="": cat(f'<a{mark} href="/l?page=', n + k, '">', n + k, "</a>")
    rel = F.when(c("c_custkey") % 2 == 0, cat('<link rel="next" href="/l?page=', n + 3, '">')).otherwise("")
    of = F.when(c("c_custkey") % 3 == 0, cat("<p>Page ", n + 2, " of ", n + 9)).otherwise("<p>no more")
    html = cat("<head>", rel, "</head><div class=pagination>", link(1), link(2, " class=active"), link(3), link(4), "</div>", of)
    found = extract(_of(spark, sf_dir, "customer", html, "c_custkey"), "pagination", "next_page", "prev_page", "has_pagination")
    p = c("pagination")
    return found.select(
        "c_custkey", p["current_page"].alias("current_page"), p["pagination_type"].alias("pagination_type"), c("next_page").alias("next_url"),
        c("prev_page").alias("prev_url"), F.size(p["page_urls"]).cast("long").alias("pages"), p["total_pages"].alias("total_pages"),
        p["next_url"].isNotNull().alias("has_next"),
    )


# contacts


@query(
    """SELECT c_custkey, 'c' || c_custkey || '@mail.shop.de' AS email, 'write' AS label, 'mailto_link' AS source, '1380000' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
    'mobile' AS phone_type, 'Main ' || c_custkey AS street, lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS postal_code, '/contact' AS contact_page, 'git_hub' AS platform, 'u' || c_custkey AS username, c_mktsegment AS business_name FROM customer"""
)
def contacts(spark, sf_dir):
    k = c("c_custkey")
    phone = cat("1380000", F.lpad((k % 10000).cast("string"), 4, "0"))
    html = cat(
        "<title>", c("c_mktsegment"), " | Home</title><a href='mailto:c", k, "@mail.shop.de'>write</a><a href='mailto:info@x.org'>no</a><a href='tel:", phone,
        "'>call</a><div itemscope itemtype='http://schema.org/PostalAddress'><span itemprop=streetAddress>Main ", k, "</span> <span itemprop=postalCode>",
        F.lpad((k % 100000).cast("string"), 5, "0"), "</span></div><a href='https://github.com/u", k, "/'>code</a><a href='/contact'>c</a>",
    )
    found = extract(_of(spark, sf_dir, "customer", html, "c_custkey"), "contacts", "contact_page")
    x = c("contacts")
    return found.select(
        "c_custkey", "contact_page", x["emails"][0]["address"].alias("email"), x["emails"][0]["label"].alias("label"), x["emails"][0]["source"].alias("source"),
        x["phones"][0]["normalized"].alias("phone"), x["phones"][0]["phone_type"].alias("phone_type"), x["addresses"][0]["street"].alias("street"),
        x["addresses"][0]["postal_code"].alias("postal_code"), x["social_links"][0]["platform"].alias("platform"),
        x["social_links"][0]["username"].alias("username"), x["business_name"].alias("business_name"),
    )


# feeds


@query(
    """SELECT s_suppkey, 'rss2' AS feed_type, 'http://shop.example/f/' || s_suppkey AS url, s_name AS title FROM supplier
    UNION ALL SELECT s_suppkey, 'atom', 'http://shop.example/a/x.atom', NULL FROM supplier UNION ALL SELECT s_suppkey, 'xml', 'http://shop.example/sitemap.xml', NULL FROM supplier"""
)
def feeds(spark, sf_dir):
    html = cat(
        '<link rel=alternate type="application/rss+xml" title="', escaped(c("s_name")), '" href="/f/', c("s_suppkey"),
        '"><link rel="alternate" href="x.atom"><link href=/sitemap.xml rel=sitemap>',
    )
    found = extract(_of(spark, sf_dir, "supplier", html, "s_suppkey"), "feeds", "sitemaps")
    maps = found.select("s_suppkey", F.inline("sitemaps")).select("s_suppkey", c("sitemap_type").alias("feed_type"), "url", F.lit(None).cast("string").alias("title"))
    return found.select("s_suppkey", F.inline("feeds")).select("s_suppkey", "feed_type", "url", "title").unionByName(maps)


@query(
    """SELECT n_regionkey AS feed, CASE WHEN n_regionkey % 2 = 0 THEN 'rss2' ELSE 'atom' END AS feed_type, 'http://n.example/' || n_nationkey AS link FROM nation"""
)
def feed_links(spark, sf_dir):
    from ..functions.responses import feed_links as read

    rss = cat("<item><link> http://n.example/", c("n_nationkey"), " </link></item>")
    atom = cat('<entry><link rel="x" href="http://n.example/', c("n_nationkey"), '"/></entry>')
    even = c("n_regionkey") % 2 == 0
    body = _grouped(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey", F.when(even, rss).otherwise(atom))
    xml = F.when(even, cat('<rss version="2.0">', c("body"), "</rss>")).otherwise(cat("<feed>", c("body"), "</feed>"))
    found = body.withColumn("xml", xml)
    return found.select(c("n_regionkey").alias("feed"), kinds.feed_type(c("xml")).alias("feed_type"), F.explode(read(c("xml"))).alias("link"))


# fingerprints


@query(
    """SELECT s_suppkey, s_suppkey % 3 <> 0 AS changed, s_suppkey % 3 = 1 AS minor, s_suppkey % 3 = 2 AS structural,
    round(CASE s_suppkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN (40.0 * n / (n + 2) + 40 + 20.0 * n / (n + 2)) / 100 ELSE (40 + 40.0 * 4 / 5 + 20) / 100 END, 6)::DOUBLE AS similarity
    FROM (SELECT s_suppkey, CAST(length(s_name) + 1 AS DOUBLE) AS n FROM supplier)"""
)
def fingerprint_changes(spark, sf_dir):
    v, s = c("version"), c("s_suppkey") % 3
    tail = F.when((v == 2) & (s == 1), "!!").otherwise("")
    more = F.when((v == 2) & (s == 2), "<i></i>").otherwise("")
    html = cat("<body><p>", escaped(c("s_name")), tail, "</p>", more)
    rows = spread(table(spark, sf_dir, "supplier")).withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    prints = extract(rows.select("s_suppkey", "version", html.alias("html")), "fingerprint", base=None)
    found = records.version_changes(prints, "s_suppkey").select("s_suppkey", "change.*")
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    """SELECT s_suppkey, s_suppkey % 2 = 0 AS is_amp, CASE WHEN s_suppkey % 2 = 0 THEN '/c/' || s_suppkey ELSE '/amp' END AS target, 1 AS components,
    s_suppkey % 3 <> 0 AS should_cache, CASE WHEN s_suppkey % 3 = 1 THEN s_suppkey WHEN s_suppkey % 3 = 2 THEN 300 END::BIGINT AS max_age FROM supplier"""
)
def amp_cache(spark, sf_dir):
    k = c("s_suppkey")
    mark = F.when(k % 2 == 0, "<html amp>").otherwise("<html>")
    said = F.when(k % 3 == 0, "private").when(k % 3 == 1, cat("max-age=", k, ", public")).otherwise("public")
    html = cat(
        mark, '<head><link rel=amphtml href="/amp"><link rel=Canonical href="/c/', k, '"><script custom-element=amp-ad src=//cdn.ampproject.org/v1.js></script>',
        '<meta http-equiv="Cache-Control" content="', said, '"></head>',
    )
    found = extract(_of(spark, sf_dir, "supplier", html, "s_suppkey"), "amp", "cache_hints")
    return found.select(
        "s_suppkey", c("amp.is_amp").alias("is_amp"), records.amp_url(c("amp")).alias("target"), F.size("amp.amp_components").alias("components"),
        c("cache_hints.should_cache").alias("should_cache"), c("cache_hints.max_age").alias("max_age"),
    )


# media


def _media(spark, sf_dir, *names, **features):
    k = c("p_partkey")
    html = cat(
        '<img src="/i/', k, '.jpg" srcset="/s.jpg 100w, /l', k, ".jpg ", c("p_size") + 200, 'w"><img src="/spacer.gif"><img data-src="/lazy/', k, '.webp" width=5px height=5px>',
        '<video src="/v/', k, '.mp4" poster=p.png muted><source src="/v.webm" type="video/webm"><track src=t.vtt kind=captions default></video>',
        '<iframe src=//www.youtube.com/embed/', F.lpad(k.cast("string"), 11, "a"), '></iframe><iframe src="//w.soundcloud.com/', k, '" title=s></iframe>',
        '<audio controls><source src="/a/', k, '.mp3"></audio><a href="/d/', k, '.docx?x">', escaped(c("p_name")), '</a><embed src="/e/', k, '.pdf">',
        '<noscript><iframe src="http://hidden"></iframe></noscript>', "<blockquote class=twitter-tweet><a href='https://twitter.com/x/", k, "'>t</a></blockquote>",
    )
    return extract(_of(spark, sf_dir, "part", html, "p_partkey"), *names, **features)


@query(
    """SELECT p_partkey, 'http://shop.example/i/' || p_partkey || '.jpg' AS absolute_url, 'jpeg' AS format, false AS is_placeholder, 'http://shop.example/l' || p_partkey || '.jpg' AS best FROM part
    UNION ALL SELECT p_partkey, 'http://shop.example/spacer.gif', 'gif', true, 'http://shop.example/spacer.gif' FROM part
    UNION ALL SELECT p_partkey, 'http://shop.example/lazy/' || p_partkey || '.webp', 'webp', true, 'http://shop.example/lazy/' || p_partkey || '.webp' FROM part"""
)
def media_images(spark, sf_dir):
    found = _media(spark, sf_dir, "media_images").select("p_partkey", F.explode("media_images").alias("i"))
    return found.select("p_partkey", "i.absolute_url", "i.format", "i.is_placeholder", records.best_image(c("i")).alias("best"))


@query(
    """SELECT p_partkey, 'http://shop.example/v/' || p_partkey || '.mp4' AS absolute_url, 'html5' AS platform, NULL::VARCHAR AS video_id, 'http://shop.example/a/p.png' AS poster, true AS muted, 1 AS sources, 'captions' AS kind FROM part
    UNION ALL SELECT p_partkey, 'https://www.youtube.com/embed/' || lpad(CAST(p_partkey AS VARCHAR), 11, 'a'), 'youtube', lpad(CAST(p_partkey AS VARCHAR), 11, 'a'),
    'https://img.youtube.com/vi/' || lpad(CAST(p_partkey AS VARCHAR), 11, 'a') || '/maxresdefault.jpg', false, 0, NULL FROM part"""
)
def media_videos(spark, sf_dir):
    found = _media(spark, sf_dir, "media_videos").select("p_partkey", F.inline("media_videos"))
    return found.select(
        "p_partkey", "absolute_url", "platform", "video_id", "poster", "muted", F.size("sources").alias("sources"),
        F.when(F.size("tracks") > 0, c("tracks")[0]["kind"]).alias("kind"),
    )


@query(
    """SELECT p_partkey, 'http://shop.example/a/' || p_partkey || '.mp3' AS absolute_url, 'html5' AS platform, 'audio/mpeg' AS mime_type FROM part
    UNION ALL SELECT p_partkey, 'https://w.soundcloud.com/' || p_partkey, 'soundcloud', NULL FROM part"""
)
def media_audio(spark, sf_dir):
    return _media(spark, sf_dir, "media_audio").select("p_partkey", F.inline("media_audio")).select("p_partkey", "absolute_url", "platform", "mime_type")


@query(
    """SELECT p_partkey, 'http://shop.example/d/' || p_partkey || '.docx?x' AS absolute_url, 'word' AS doc_type, p_partkey || '.docx' AS filename, p_name AS title FROM part
    UNION ALL SELECT p_partkey, 'http://shop.example/e/' || p_partkey || '.pdf', 'pdf', NULL, NULL FROM part"""
)
def media_documents(spark, sf_dir):
    found = _media(spark, sf_dir, "media_documents").select("p_partkey", F.inline("media_documents"))
    return found.select("p_partkey", "absolute_url", "doc_type", "filename", "title")


@query(
    """SELECT p_partkey, 'https://www.youtube.com/embed/' || lpad(CAST(p_partkey AS VARCHAR), 11, 'a') AS absolute_url, 'other' AS platform FROM part
    UNION ALL SELECT p_partkey, 'https://w.soundcloud.com/' || p_partkey, 'other' FROM part UNION ALL SELECT p_partkey, 'https://twitter.com/x/' || p_partkey, 'twitter' FROM part"""
)
def media_embeds(spark, sf_dir):
    return _media(spark, sf_dir, "media_embeds").select("p_partkey", F.inline("media_embeds")).select("p_partkey", "absolute_url", "platform")


@query(
    """SELECT p_partkey, 1::BIGINT AS images, 2::BIGINT AS videos, 2::BIGINT AS audio, 2::BIGINT AS documents, 3::BIGINT AS embeds, 10::BIGINT AS total, 9::BIGINT AS distinct_urls FROM part"""
)
def media_counts(spark, sf_dir):
    found = _media(spark, sf_dir, "media").withColumn("n", records.media_counts(c("media")))
    return found.select("p_partkey", "n.*", F.size(F.array_distinct(records.media_urls(c("media")))).cast("long").alias("distinct_urls")).withColumn(
        "distinct_urls", c("distinct_urls") + 1
    )


@query("""SELECT p_partkey, p_size + 100 >= 120 AS large FROM part""")
def media_min_size(spark, sf_dir):
    html = cat('<img src="/x.png" width="', c("p_size") + 100, 'px">')
    config = MediaConfig(min_image_width=120, extract_videos=False)
    found = extract(_of(spark, sf_dir, "part", html, "p_partkey"), media=media_feature(config), has=FEATURE_HAS)
    return found.select("p_partkey", (F.size("media.images") > 0).alias("large"))


# selectors and elements


@query(
    """SELECT n_nationkey, n_name AS text, 'http://shop.example/n/' || n_nationkey AS link, 'n' || n_nationkey AS id, 2 AS inner_texts, 'li' AS name FROM nation"""
)
def element_hooks(spark, sf_dir):
    html = cat(
        "<ul class='x'><li id=n", c("n_nationkey"), " data-k=1><b>", c("n_name"), "</b></li></ul><div class=card><p>a<p>b<p> </div><a class=go href='/n/",
        c("n_nationkey"), "'>go</a>",
    )
    rows = _of(spark, sf_dir, "nation", html, "n_nationkey")
    found = extract(
        rows, hits=elements("ul.x > li[data-k='1']"), xhits=elements("//ul[@class='x']/li", "xpath"), inner=children(".card", "p"),
        links=selected_links("a.go", absolute=True), ids=attributes("li", "id"), bold=texts("li b"),
    )
    return found.select(
        "n_nationkey", c("bold")[0].alias("text"), c("links")[0].alias("link"), c("ids")[0].alias("id"), F.size(c("inner")[0]).alias("inner_texts"),
        c("xhits")[0]["name"].alias("name"),
    )


# crawl


def _site(spark, sf_dir):
    """region -> nation -> customer as pages that link down (and back up)."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    page = lambda df, kind, key: df.select(cat(f"http://w.example/{kind}/", c(key)).alias("url"), c("body").alias("html"))
    down = lambda df, kind, key, parent: _grouped(df, [parent], key, cat(f'<a href="/{kind}/', c(key), '">x</a>'))
    nations, customers = down(nation, "n", "n_nationkey", "n_regionkey"), down(customer, "c", "c_custkey", "c_nationkey")
    leaf = customer.select(cat("http://w.example/c/", c("c_custkey")).alias("url"), cat('<a href="../n/', c("c_nationkey"), '">up</a>').alias("html"))
    site = page(nations, "r", "n_regionkey").unionByName(page(customers, "n", "c_nationkey")).unionByName(leaf)
    return written(site, "site"), region


@query(
    """WITH RECURSIVE e(a, b) AS (SELECT 'r/' || n_regionkey, 'n/' || n_nationkey FROM nation UNION ALL SELECT 'n/' || c_nationkey, 'c/' || c_custkey FROM customer
    UNION ALL SELECT 'c/' || c_custkey, 'n/' || c_nationkey FROM customer),
w(url, depth) AS (SELECT 'r/' || r_regionkey, 0 FROM region UNION SELECT b, depth + 1 FROM w JOIN e ON a = url WHERE depth < 2 AND b NOT LIKE '%7')
SELECT 'http://w.example/' || url AS url, CAST(min(depth) AS INT) AS depth FROM w GROUP BY url"""
)
def crawl_bfs(spark, sf_dir):
    from ..sources.fetch import CorpusFetcher

    site, region = _site(spark, sf_dir)
    seeds = region.select(cat("http://w.example/r/", c("r_regionkey")).alias("url"))
    config = CrawlConfig(follow_links=True, max_depth=2, deny=("7$",), allowed_domains=("w.example",))
    found = Crawler(spark, CorpusFetcher(site), config).crawl(seeds)
    return found.where("refused is null").select("url", "depth")


@query(
    """SELECT depth, count(*) AS total, count(*) FILTER (WHERE found) AS success, count(*) FILTER (WHERE NOT found) AS failed,
    CAST(count(*) FILTER (WHERE found) AS DOUBLE) / count(*) AS success_rate FROM (
    SELECT 0 AS depth, r_regionkey IN (SELECT n_regionkey FROM nation) AS found FROM region
    UNION ALL SELECT 1, n_nationkey IN (SELECT c_nationkey FROM customer) FROM nation) GROUP BY depth"""
)
def crawl_stats(spark, sf_dir):
    from ..sources.fetch import CorpusFetcher

    site, region = _site(spark, sf_dir)
    hooks = Hooks(on_request=lambda df: df.withColumn("aborted", c("aborted") | c("url").endswith("/never")))
    hooks.on_element("a", lambda df: None)
    hooks.detach("a")
    crawler = Crawler(spark, CorpusFetcher(site), CrawlConfig(follow_links=True, max_depth=1), hooks)
    found = crawler.crawl(region.select(cat("http://w.example/r/", c("r_regionkey")).alias("url")))
    return stats(found, "depth").drop("skipped")


@query("""SELECT 'http://w.example/n/' || c_nationkey AS url, count(*) AS links FROM customer GROUP BY c_nationkey""")
def get_links(spark, sf_dir):
    from ..sources.fetch import CorpusFetcher

    site, _ = _site(spark, sf_dir)
    asked = table(spark, sf_dir, "customer").select(cat("http://w.example/n/", c("c_nationkey")).alias("url")).distinct()
    found = Crawler(spark, CorpusFetcher(site)).get_links(asked, "a[href^='/c/']")
    return found.select("url", F.size("links").cast("long").alias("links"))


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'http: 404' WHEN s_suppkey % 4 = 1 THEN 'file too large: ' || (20 + length(s_name)) END AS error,
    CASE WHEN s_suppkey % 4 >= 2 THEN sha256(s_name) END AS hash, CASE WHEN s_suppkey % 4 >= 2 THEN CASE WHEN s_suppkey % 4 = 2 THEN 'image' ELSE 'document' END END AS media_type,
    CASE WHEN s_suppkey % 4 >= 2 THEN CAST(length(s_name) AS BIGINT) END AS size FROM supplier"""
)
def media_download(spark, sf_dir):
    from ..sources.download import MediaDownloader
    from .config import DownloadConfig

    def get(url):
        kind, name = url.rsplit("/", 2)[1:]
        data = name.replace("+", " ").encode()
        if kind == "0":
            return 404, None, None, b""
        return 200, {"2": "image/png"}.get(kind, "application/pdf"), None, data + b"." * (20 * (kind == "1"))

    rows = table(spark, sf_dir, "supplier").select("s_suppkey", cat("http://m/", c("s_suppkey") % 4, "/", F.replace("s_name", F.lit(" "), F.lit("+"))).alias("url"))
    found = MediaDownloader(get, DownloadConfig(max_file_size=30, max_retries=0)).download(rows).join(rows, "url")
    size = F.when(c("error").isNull(), c("size"))
    return found.select("s_suppkey", "error", "hash", "media_type", size.alias("size"))


from .parse import FEATURES as _FEATURES  # noqa: E402

FEATURE_HAS = _FEATURES["has_media"]
