"""Queries over the stored pages and documents as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kinds, responses, text, urls
from ..operators import media as media_tables
from ..sources.fetch import CompositeFetcher, CorpusFetcher
from . import article_links as scoring
from . import records
from .config import ExtractorConfig, LimitRule
from .crawl import matching_rule, schedule
from .parse import extract, first_text, parse_pages, readable, selected_links, texts
from .ranking import row_numbers
from .registry import cat, pages, query, spread, sql_any, sql_words, table
from .shared import written

_HOST = "lower(nullif(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), ''))"
HOST = _HOST.format("url")
_OFF = " OR ".join(f"contains(url, '{p}')" for p in ExtractorConfig().non_article_paths)
_NAV = ", ".join(f"'{w}'" for w in scoring.NAV_WORDS)


@query(
    rf"""
WITH a AS (SELECT page_id, url AS page, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
             unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text,
             generate_subscripts(regexp_extract_all(html, '<a href="'), 1) AS pos FROM pages),
c AS (SELECT page_id, pos, href, text, regexp_extract(page, '^[a-z]+://[^/?#]*') || '/' ||
        replace(url_encode(substr(href, 2)), '%2C', ',') AS url, count(*) OVER (PARTITION BY page_id) AS cluster FROM a),
s AS (SELECT *, (CASE WHEN length(text) >= 8 THEN CASE WHEN length(text) <= 120 THEN 15 ELSE 10 END WHEN length(text) = 0 THEN -5 ELSE 0 END
   + CASE WHEN cluster >= 4 THEN 15 WHEN cluster >= 2 THEN 5 ELSE 0 END
   + CASE WHEN len(list_filter(string_split(url, '/')[4:], lambda x: x <> '')) >= 2 THEN 3 ELSE -10 END
   + CASE WHEN NOT {sql_any('url', urls.EXCLUDE)} AND {sql_any('url', urls.INCLUDE)} THEN 5 ELSE 0 END
   + CASE WHEN lower(text) IN ({_NAV}) THEN -15 ELSE 0 END
   + CASE WHEN contains(href, '?page=') OR contains(href, '&page=') THEN -20 ELSE 0 END
   + CASE WHEN regexp_matches(text, '^[0-9]+$') THEN -15 ELSE 0 END
   + CASE WHEN {_OFF} THEN -20 ELSE 0 END) / 10.0::DOUBLE AS score FROM c)
SELECT page_id, url, arg_max(text, length(text) * 1000 - pos) AS text, max(score) AS score, max(cluster) AS cluster_size
FROM s GROUP BY page_id, url HAVING max(score) >= 1.5"""
)
def article_links(spark, sf_dir):
    return scoring.article_links(pages(spark, sf_dir))


@query(f"SELECT page_id, {sql_any('url', urls.INCLUDE)} AND NOT {sql_any('url', urls.EXCLUDE)} AS is_article FROM pages")
def article_url_rule(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.is_article_url(F.col("url")).alias("is_article"))


_PAGE_SQL = "coalesce(" + ", ".join(
    f"CAST(CASE WHEN n{k} < 4294967296 THEN n{k} END AS BIGINT)" for k in range(4)
) + ")"
_PAGE_PATTERNS = (r"(?i)[?&](?:pg|page|p)=([0-9]+)", r"(?i)/page/([0-9]+)", r"(?i)(?:pg|page|p)[=/]([0-9]+)", r"/([0-9]+)/?$")
_PAGE_NUMBERS = ", ".join(
    f"TRY_CAST(nullif(regexp_extract(url, '{p}', 1), '') AS DECIMAL(38,0)) AS n{k}" for k, p in enumerate(_PAGE_PATTERNS)
)


@query(f"SELECT page_id, {_PAGE_SQL} AS page_number FROM (SELECT page_id, {_PAGE_NUMBERS} FROM pages)")
def page_number_from_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.page_number(F.col("url")).alias("page_number"))


@query(
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '(?i)[?&](?:pg|page|p)=[0-9]+')
    THEN regexp_replace(url, '(?i)([?&](?:pg|page|p)=)[0-9]+', '\1' || (page_id % 9 + 1))
  WHEN regexp_matches(url, '(?i)/page/[0-9]+/?') THEN regexp_replace(url, '(?i)(/page/)[0-9]+/?', '\1' || (page_id % 9 + 1))
  ELSE regexp_extract(url, '^[^#]*') || CASE WHEN contains(regexp_extract(url, '^[^#]*'), '?') THEN '&' ELSE '?' END
    || 'page=' || (page_id % 9 + 1) || regexp_extract(url, '#.*$') END AS page_url FROM pages"""
)
def generate_page_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.page_url(F.col("url"), F.col("page_id") % 9 + 1).alias("page_url"))


@query(
    f"""SELECT page_id, {HOST} AS host, coalesce({HOST} IS NULL OR (({HOST} = 'example.com' OR ends_with({HOST}, '.example.com')
    OR {HOST} = 'example.org' OR ends_with({HOST}, '.example.org')) AND NOT ({HOST} = 'blog.example.org'
    OR ends_with({HOST}, 'ththon.example.org'))), true) AS allowed FROM pages"""
)
def host_allow_deny(spark, sf_dir):
    url = F.col("url")
    ok = urls.domain_allowed(url, ("example.com", "example.org"), ("blog.example.org", "ththon.example.org"))
    # a deny entry matches the host or what lies below it
    return table(spark, sf_dir, "pages").select("page_id", urls.url_host(url).alias("host"), ok.alias("allowed"))


@query(
    r"""SELECT page_id, NOT regexp_matches(url, '\.html$') AND regexp_matches(url, '/(?:en|fr)/') AS allowed FROM pages"""
)
def url_filter(spark, sf_dir):
    ok = urls.url_allowed(F.col("url"), ("/(?:en|fr)/", "(broken"), (r"\.html$",))
    return table(spark, sf_dir, "pages").select("page_id", ok.alias("allowed"))


RULES = (LimitRule("*.example.com", 2, 1.5), LimitRule("blog*", 1, 4.0), LimitRule("*example.net", 3, 0.5))
_RULE_SQL = "CASE WHEN regexp_matches(host, '.*.example.com') THEN 0 WHEN regexp_matches(host, 'blog.*') THEN 1 WHEN regexp_matches(host, '.*example.net') THEN 2 END"


@query(
    f"""SELECT host, rule_order, CASE rule_order WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 END AS parallelism,
    CAST(CASE rule_order WHEN 0 THEN 1.5 WHEN 1 THEN 4.0 WHEN 2 THEN 0.5 END AS DOUBLE) AS delay_s, n
    FROM (SELECT host, {_RULE_SQL} AS rule_order, count(*) AS n FROM (SELECT {HOST} AS host FROM pages) GROUP BY host)"""
)
def limit_rule_match(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").groupBy(urls.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return matching_rule(hosts, RULES).select("host", "rule_order", "parallelism", "delay_s", "n")


@query(
    f"""SELECT page_id, host, CASE WHEN rule_order IS NULL THEN 0.0::DOUBLE ELSE
    floor((row_number() OVER (PARTITION BY host ORDER BY page_id, url) - 1) / CASE rule_order WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END)
    * CAST(CASE rule_order WHEN 0 THEN 1.5 WHEN 1 THEN 4.0 ELSE 0.5 END AS DOUBLE) END AS start_s
    FROM (SELECT *, {_RULE_SQL} AS rule_order FROM (SELECT page_id, url, {HOST} AS host FROM pages))"""
)
def politeness_schedule(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", "url", F.col("page_id").alias("seq"))
    return schedule(found, RULES).select("page_id", "host", "start_s")


_PATHS_OF = "WITH p AS (SELECT unnest([{}]) AS path) SELECT DISTINCT url, regexp_replace(url, '/+$', '') || path AS candidate FROM pages, p"


@query(_PATHS_OF.format(", ".join(f"'{p}'" for p in kinds.FEED_PATHS)))
def wellknown_feeds(spark, sf_dir):
    return kinds.well_known(table(spark, sf_dir, "pages"))


@query(_PATHS_OF.format(", ".join(f"'{p}'" for p in kinds.SITEMAP_PATHS)))
def wellknown_sitemaps(spark, sf_dir):
    return kinds.well_known(table(spark, sf_dir, "pages"), paths=kinds.SITEMAP_PATHS)


_TAILS = ("feed", "atom", "feed.atom", "x.json", "sitemap-news.xml", "sitemap.txt", "sitemap.xml.gz", "image.xml", "video.xml", "index.xml", "map.xml")
_TAIL_SQL = "[" + ", ".join(f"'{t}'" for t in _TAILS) + f"][(page_id % {len(_TAILS)}) + 1]"


@query(
    f"""SELECT page_id, CASE WHEN contains(u, '/atom') OR ends_with(u, '.atom') OR ends_with(u, 'atom.xml') THEN 'atom'
    WHEN ends_with(u, '.json') OR contains(u, 'jsonfeed') THEN 'json' ELSE 'rss2' END AS feed_type,
    CASE WHEN ends_with(u, '.txt') THEN 'text' WHEN ends_with(u, '.gz') OR ends_with(u, '.gzip') THEN 'gzip' WHEN contains(u, 'news') THEN 'news'
    WHEN contains(u, 'image') THEN 'image' WHEN contains(u, 'video') THEN 'video' WHEN contains(u, 'index') THEN 'index' ELSE 'xml' END AS sitemap_type
    FROM (SELECT page_id, lower(regexp_replace(url, '[?#].*$', '') || '/' || {_TAIL_SQL}) AS u FROM pages)"""
)
def feed_url_type(spark, sf_dir):
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("page_id") % len(_TAILS) + 1).cast("int"))
    url = cat(F.regexp_replace("url", "[?#].*$", ""), "/", tail)
    return table(spark, sf_dir, "pages").select(
        "page_id", kinds.feed_type_of_url(url).alias("feed_type"), kinds.sitemap_type(url).alias("sitemap_type")
    )


_TOKENS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
_WORDS = f"len(list_filter({_TOKENS}, lambda w: regexp_matches(w, '\\pL')))"
_LETTERS = r"lower(regexp_replace(regexp_replace(w, '^\PL+', ''), '\PL+$', ''))"
_SENTENCES = "greatest(len(regexp_extract_all(text, '[.!?。！？]')), 1)"


@query(f"SELECT doc_id, CAST({_WORDS} AS BIGINT) AS words, CAST({_SENTENCES} AS BIGINT) AS sentences, len({_TOKENS}) >= 50 AS substantial FROM documents")
def word_metrics(spark, sf_dir):
    t = F.col("text")
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", text.count_words(t).alias("words"), text.count_sentences(t).alias("sentences"), text.is_substantial(t).alias("substantial")
    )


@query(
    rf"""WITH w AS (SELECT doc_id, {_LETTERS} AS l FROM (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents)),
n AS (SELECT doc_id, l, len(regexp_extract_all(l, '[aeiouy]+')) AS a FROM w),
m AS (SELECT *, a - (CASE WHEN l LIKE '%e' AND a > 1 THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(l, '[^aeiouy]le$') THEN 1 ELSE 0 END) AS b FROM n),
s AS (SELECT doc_id, sum(CASE WHEN l = '' THEN 0 WHEN strlen(l) <= 3 THEN 1
   ELSE greatest(b - CASE WHEN regexp_matches(l, 'e[sd]$') AND b > 1 THEN 1 ELSE 0 END, 1) END) AS syllables FROM m GROUP BY doc_id),
d AS (SELECT doc_id, CAST({_WORDS} AS DOUBLE) AS words, CAST({_SENTENCES} AS DOUBLE) AS sentences FROM documents)
SELECT doc_id, CAST(coalesce(syllables, 0) AS BIGINT) AS syllables,
  round(CASE WHEN words = 0 THEN 0.0 ELSE least(greatest(206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words), 0.0), 100.0) END, 6)::DOUBLE AS reading_ease,
  round(CASE WHEN words = 0 THEN 0.0 ELSE greatest(0.39 * (words / sentences) + 11.8 * (syllables / words) - 15.59, 0.0) END, 6)::DOUBLE AS grade
FROM d LEFT JOIN s USING (doc_id)"""
)
def flesch(spark, sf_dir):
    found = spread(table(spark, sf_dir, "documents")).select("doc_id", text.measures(F.col("text")).alias("m"))
    m = F.col("m")
    return found.select(
        "doc_id", m["syllables"].alias("syllables"), F.round(text.reading_ease(m), 6).alias("reading_ease"), F.round(text.grade(m), 6).alias("grade")
    )


_HITS = ", ".join(
    f"count(*) FILTER (WHERE l IN ({', '.join(chr(39) + w + chr(39) for w in text.STOP_WORDS[k])})) AS {k}" for k in ("en", "fr", "de", "es")
)


@query(
    rf"""WITH w AS (SELECT doc_id, {_LETTERS} AS l FROM (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents)),
h AS (SELECT doc_id, {_HITS} FROM w WHERE strlen(l) > 2 GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN greatest(en, fr, de, es) = 0 THEN NULL WHEN es >= de AND es >= fr AND es >= en THEN 'es'
  WHEN de >= fr AND de >= en THEN 'de' WHEN fr >= en THEN 'fr' ELSE 'en' END AS language
FROM documents LEFT JOIN h USING (doc_id)"""
)
def detect_language(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.detect_language(F.col("text")).alias("language"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, '|', '<td>'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS bare,
    regexp_replace(text, '\n', ' ', 'g') = text AS one_line, CASE WHEN strlen(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END AS short
    FROM documents"""
)
def text_cleaning(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.strip_tags(F.replace(t, F.lit("|"), F.lit("<td>"))).alias("bare"),
        (F.replace(t, F.lit("\n"), F.lit(" ")) == t).alias("one_line"), text.truncate_text(text.clean_text(t), 100).alias("short"),
    )


_VALID = """regexp_matches(address, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')
    AND NOT regexp_matches(lower(address), '^(?:admin|donotreply|example|info|no-?reply|test)@')
    AND lower(split_part(address, '@', 2)) NOT IN ('domain.com', 'domain.org', 'example.com', 'example.net', 'example.org', 'local', 'localhost', 'test.com')
    AND len(string_split(split_part(address, '@', 2), '.')) <= 3"""


@query(
    rf"""SELECT DISTINCT doc_id, address, {_VALID} AS valid FROM (SELECT doc_id,
    unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')) AS address FROM documents)"""
)
def emails_in_text(spark, sf_dir):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)))
    docs = table(spark, sf_dir, "documents").where(F.col("text").contains("@"))
    return docs.select("doc_id", F.explode(found).alias("address")).withColumn("valid", kinds.valid_email(F.col("address")))


_GAP = r"[\s.-]?"
_PHONE = rf"(?:\+?\d{{1,3}}{_GAP})?\(?\d{{2,4}}\)?{_GAP}\d{{3,4}}{_GAP}\d{{3,4}}(?:\s*(?:#|ext|x|分机)\s*\d+)?\b"
_TOLLFREE = r"(?:\+?1[\s.-]?)?8(?:00|33|44|55|66|77|88)[\s.-]?\d{3}[\s.-]?\d{4}"


@query(
    rf"""WITH f AS (SELECT doc_id, regexp_extract_all(text, '{_TOLLFREE}') AS free, regexp_extract_all(text, '{_PHONE}') AS every FROM documents),
n AS (SELECT doc_id, unnest(free || every) AS number, unnest(range(len(free) + len(every))) AS k, len(free) AS frees FROM f),
d AS (SELECT doc_id, regexp_replace(number, '[^0-9]', '', 'g') AS d, arg_min(number, k) AS number, min(k) < any_value(frees) AS free FROM n GROUP BY ALL)
SELECT doc_id, number, d AS normalized, CASE WHEN free THEN 'toll_free' WHEN length(d) BETWEEN 10 AND 12 AND
    (CASE WHEN d LIKE '1%' AND length(d) >= 11 THEN substr(d, 2, 3) ELSE substr(d, 1, 3) END) IN ('800','833','844','855','866','877','888') THEN 'toll_free'
    WHEN regexp_matches(d, '^1[3-9][0-9]{{9}}$') THEN 'mobile' WHEN d LIKE '0%' AND length(d) BETWEEN 10 AND 12 THEN 'landline' ELSE 'unknown' END AS phone_type FROM d"""
)
def phones_in_text(spark, sf_dir):
    free, every = (F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (_TOLLFREE, _PHONE))
    found = spread(table(spark, sf_dir, "documents")).where(F.col("text").rlike("[0-9]")).select("doc_id", free.alias("free"), every.alias("every"))
    numbers = found.select("doc_id", F.size("free").alias("frees"), F.posexplode(F.concat("free", "every")).alias("k", "number"))
    n = F.col("number")
    first = numbers.withColumn("normalized", kinds.phone_digits(n)).groupBy("doc_id", "normalized").agg(
        F.min_by("number", "k").alias("number"), (F.min("k") < F.first("frees")).alias("free")
    )
    kind = F.when(F.col("free"), "toll_free").otherwise(kinds.phone_type(n))
    return first.select("doc_id", "number", "normalized", kind.alias("phone_type"))


_MARKS = (
    "px-captcha", "cf-challenge", "Ray ID 1 cloudflare please enable javascript", "datadome", "akamai bot", "access to this page was denied human",
    "<title>x</title> robot challenge", "errors.edgesuite.net access denied", "reference #1 errors.edgekey.net", "cloudflare error 1020", "403 forbidden", "hello",
)
_MARK_SQL = "[" + ", ".join(f"'{m}'" for m in _MARKS) + f"][(page_id % {len(_MARKS)}) + 1]"


def _answers(spark, sf_dir):
    """Whole pages as responses whose status and marks follow from the page number."""
    mark = F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("page_id") % len(_MARKS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.when(F.col("page_id") % 2 == 0, 200).when(F.col("page_id") % 3 == 0, 403).otherwise(404).alias("status"),
        F.create_map(F.lit("content-type"), F.when(F.col("page_id") % 7 == 0, "application/json").otherwise("text/html")).alias("headers"),
        cat(F.col("html"), mark).alias("body"),
    )


_CHALLENGE_SQL = """status = 200 AND (contains(b, 'px-captcha') OR contains(b, 'cf-challenge') OR (contains(b, 'ray id') AND contains(b, 'cloudflare') AND contains(b, 'enable javascript'))
    OR contains(b, 'datadome') OR (contains(b, 'akamai') AND (contains(b, 'bot') OR contains(b, 'challenge')))
    OR (contains(b, 'access to this page') AND contains(b, 'denied') AND contains(b, 'human'))
    OR (contains(b, '<title>') AND contains(b, 'challenge') AND (contains(b, 'robot') OR contains(b, 'blocked') OR contains(b, 'access denied'))))"""
_DENIED_SQL = """status BETWEEN 400 AND 499 AND ((contains(b, 'edgesuite.net') OR contains(b, 'edgekey.net')) AND (contains(b, 'access denied') OR contains(b, 'permission'))
    OR (size < 5000 AND contains(b, 'reference #') AND (contains(b, 'errors.edgesuite.net') OR contains(b, 'errors.edgekey.net')))
    OR (status = 403 AND contains(b, 'cloudflare') AND (contains(b, 'denied') OR contains(b, 'error 1020')))
    OR (status = 403 AND size < 3000 AND (contains(b, 'access denied') OR contains(b, '403 forbidden') OR contains(b, 'not allowed'))))"""


@query(
    f"""WITH r AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 200 WHEN page_id % 3 = 0 THEN 403 ELSE 404 END AS status,
    html || {_MARK_SQL} AS body FROM pages), l AS (SELECT *, lower(body) AS b, strlen(body) AS size FROM r)
SELECT page_id, status BETWEEN 200 AND 299 AS success, {_CHALLENGE_SQL} AS challenge, {_DENIED_SQL} AS denied FROM l"""
)
def response_detectors(spark, sf_dir):
    seen = (F.col("status"), F.col("headers"), F.col("body"))
    return _answers(spark, sf_dir).select(
        "page_id", responses.is_success(F.col("status")).alias("success"), responses.is_bot_challenge(*seen).alias("challenge"),
        responses.is_access_denied(*seen).alias("denied"),
    )


@query(
    """SELECT status, count(*) AS total, count(*) FILTER (WHERE outcome = 'success') AS success, count(*) FILTER (WHERE outcome = 'failed') AS failed,
    count(*) FILTER (WHERE outcome = 'skipped') AS skipped, CAST(count(*) FILTER (WHERE outcome = 'success') AS DOUBLE) / count(*) AS success_rate
    FROM (SELECT o_orderpriority AS status, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'skipped' END AS outcome FROM orders) GROUP BY status"""
)
def scrape_stats(spark, sf_dir):
    o = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("site"), F.when(o == "F", "success").when(o == "O", "failed").otherwise("skipped").alias("status")
    )
    return responses.scrape_stats(rows, "site").withColumnRenamed("site", "status")


_EXT = "jpg webp mp4 ogg mp3 wav pdf docx xlsx pptx csv epub zip tar.gz svg".split()
_EXT_SQL = "[" + ", ".join(f"'{e}'" for e in _EXT) + f"][(p_partkey % {len(_EXT)}) + 1]"
_HOSTS = "youtu.be vimeo.com dailymotion.com twitch.tv netflix.com soundcloud.com anchor.fm google.com/maps codepen.io linkedin.com t.me cdn.example".split()
_HOSTS_SQL = "[" + ", ".join(f"'{e}'" for e in _HOSTS) + f"][(p_partkey % {len(_HOSTS)}) + 1]"
_FILE_SQL = f"'https://' || {_HOSTS_SQL} || '/' || replace(p_name, ' ', '-') || '/' || p_partkey || '.' || {_EXT_SQL} || CASE WHEN p_partkey % 5 = 0 THEN '?v=' || p_size ELSE '' END"
_KIND_SQL = " ".join(f"WHEN e IN ({', '.join(chr(39) + x + chr(39) for x in v.split())}) THEN '{k}'" for k, v in kinds.MEDIA_EXTENSIONS.items())
_DOC_SQL = " ".join(f"WHEN contains(u, '.{e}') THEN '{k}'" for e, k in media_tables.DOCUMENTS)


def _files(spark, sf_dir):
    pick = lambda options: F.element_at(F.array(*map(F.lit, options)), (F.col("p_partkey") % len(options) + 1).cast("int"))
    tail = F.when(F.col("p_partkey") % 5 == 0, cat("?v=", F.col("p_size"))).otherwise("")
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    url = cat("https://", pick(_HOSTS), "/", name, "/", F.col("p_partkey"), ".", pick(_EXT), tail)
    return table(spark, sf_dir, "part").select("p_partkey", url.alias("url"))


@query(
    f"""WITH f AS (SELECT p_partkey, {_FILE_SQL} AS url FROM part), g AS (SELECT *, lower(url) AS u,
    lower(nullif(regexp_extract(url, '^[^?#]*?\\.([A-Za-z0-9]{{1,5}})(?:[?#]|$)', 1), '')) AS e FROM f)
SELECT p_partkey, e AS extension, CASE {_KIND_SQL} ELSE 'other' END AS media_type,
  {sql_words('u', media_tables.VIDEO_PLATFORMS)} AS video_platform, {sql_words('u', media_tables.AUDIO_PLATFORMS)} AS audio_platform,
  {sql_words('url', media_tables.EMBED_PLATFORMS)} AS embed_platform, CASE {_DOC_SQL} ELSE 'other' END AS document_type,
  regexp_matches(u, '\\.(?:csv|docx?|epub|od[pst]|pdf|pptx?|rtf|txt|xlsx?)(?:$|[?&])') AS is_document,
  regexp_matches(u, '\\.(?:aac|flac|m4a|mp3|og[ag]|opus|wav|wma)$') AS is_audio
FROM g"""
)
def media_kinds(spark, sf_dir):
    url = F.col("url")
    ext = kinds.extension(url)
    return _files(spark, sf_dir).select(
        "p_partkey", ext.alias("extension"), F.coalesce(kinds.media_type_of_extension(ext), F.lit("other")).alias("media_type"),
        kinds.video_platform(url).alias("video_platform"), kinds.audio_platform(url).alias("audio_platform"),
        kinds.embed_platform(url).alias("embed_platform"), kinds.document_type(url).alias("document_type"),
        kinds.is_document_url(url).alias("is_document"), kinds.is_audio_file(url).alias("is_audio"),
    )


@query(
    f"""SELECT p_partkey, sha256(url) AS hash, p_partkey || '.' || {_EXT_SQL} AS filename, regexp_matches(url, '(?i)^https?://') AS downloadable
    FROM (SELECT p_partkey, {_FILE_SQL} AS url FROM part)"""
)
def sha256_names(spark, sf_dir):
    url = F.col("url")
    return _files(spark, sf_dir).select(
        "p_partkey", kinds.sha256(url.cast("binary")).alias("hash"), urls.filename(url).alias("filename"), urls.is_downloadable(url).alias("downloadable")
    )


_TITLE = "replace(replace(replace(regexp_extract(html, '<{0}>([^<]*)</{0}>', 1), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·')"


@query(
    f"""SELECT page_id, trim(replace({_TITLE.format('title')}, '&amp;', '&')) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language,
    regexp_extract(html, 'charset="([^"]*)"', 1) AS charset FROM pages"""
)
def page_title(spark, sf_dir):
    return extract(pages(spark, sf_dir), "title", "language", "charset").select("page_id", "title", "language", "charset")


@query(
    """SELECT page_id, CAST(strlen(html) AS BIGINT) AS html_size, CAST(len(regexp_extract_all(html, '<!--')) AS BIGINT) AS comments,
    CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS items, CAST(len(regexp_extract_all(html, '<a href')) AS BIGINT) AS links FROM pages"""
)
def page_stats(spark, sf_dir):
    found = extract(pages(spark, sf_dir), "stats", "lists", hrefs=texts("a"))
    return found.select(
        "page_id", F.col("stats.html_size"), F.col("stats.comment_count").alias("comments"), F.size("lists").cast("long").alias("items"),
        F.size("hrefs").cast("long").alias("links"),
    )


_LINK_SQL = "unnest(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)))"


@query(f"SELECT page_id, href FROM (SELECT page_id, {_LINK_SQL} AS href FROM pages)")
def css_links(spark, sf_dir):
    found = extract(pages(spark, sf_dir), links=selected_links("nav > ul > li a[href]"))
    return found.select("page_id", F.explode("links").alias("href"))


@query(
    f"""SELECT DISTINCT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/' || replace(url_encode(substr(href, 2)), '%2C', ',') AS url
    FROM (SELECT page_id, url, {_LINK_SQL} AS href FROM pages)"""
)
def xpath_links(spark, sf_dir):
    found = extract(pages(spark, sf_dir), links=selected_links("//li/a/@href", "xpath", absolute=True))
    return found.select("page_id", F.explode("links").alias("url"))


@query(
    f"""WITH l AS (SELECT page_id, {_LINK_SQL} AS href FROM pages)
SELECT page_id, count(*) AS total, count(*) AS internal, 0::BIGINT AS external, 0::BIGINT AS nofollow, count(*) AS followable FROM l GROUP BY page_id"""
)
def page_link_stats(spark, sf_dir):
    found = extract(pages(spark, sf_dir), "links").withColumn("s", records.link_stats(F.col("links")))
    return found.select("page_id", "s.total", "s.internal", "s.external", "s.nofollow", "s.followable")


@query(
    f"""WITH p AS (SELECT page_id, {HOST} AS host, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
    CAST(len(regexp_extract_all(html, '<a href')) AS BIGINT) AS links FROM pages)
SELECT lang, host, count(*) AS n, CAST(sum(links) AS BIGINT) AS links FROM p GROUP BY ROLLUP (lang, host)"""
)
def corpus_rollup(spark, sf_dir):
    found = extract(pages(spark, sf_dir), "language", hrefs=texts("a")).select(
        F.col("language").alias("lang"), urls.url_host(F.col("url")).alias("host"), F.size("hrefs").alias("links")
    )
    return records.corpus_rollup(found, "lang", "host", links=F.sum("links"))


@query(
    f"""WITH r AS (SELECT page_id, page_id % 2 = 0 AS there, CASE WHEN page_id % 4 = 0 THEN 200 ELSE 403 END AS status, html || {_MARK_SQL} AS body FROM pages),
l AS (SELECT *, lower(body) AS b, strlen(body) AS size FROM r),
w AS (SELECT page_id, status, CASE WHEN NOT there THEN 'http: not found' WHEN {_CHALLENGE_SQL} THEN 'bot_challenge' WHEN {_DENIED_SQL} THEN 'access_denied' END AS why FROM l)
SELECT page_id, why AS refused, CASE WHEN why IS NULL THEN 'first' WHEN page_id % 5 <> 0 THEN 'second' END AS fetcher,
  CASE WHEN why IS NULL THEN status WHEN page_id % 5 <> 0 THEN 200 END AS status,
  CASE WHEN why IS NOT NULL AND page_id % 5 = 0 THEN 'all fetchers failed: http: not found' END AS error,
  CASE WHEN why IS NULL THEN 0 WHEN page_id % 5 <> 0 THEN 1 ELSE 2 END::BIGINT AS rejected FROM w"""
)
def composite_failover(spark, sf_dir):
    from ..sources.fetch import requests

    found, k = _answers(spark, sf_dir), F.col("page_id")
    first = found.where(k % 2 == 0).withColumn("status", F.when(k % 4 == 0, 200).otherwise(403))
    second = table(spark, sf_dir, "pages").where(k % 5 != 0).select("page_id", "url", F.lit("<html>ok</html>").alias("html"))
    # a URL may stand on several pages: each is a request of its own
    one = ("page_id",)
    tiers = CompositeFetcher(
        [CorpusFetcher(first, html="body", status="status", name="first", keys=one), CorpusFetcher(second, name="second", keys=one)]
    )
    got, log = tiers.fetch_logged(requests(found, keys=one), one)
    tries = log.groupBy("page_id").agg(F.count("*").alias("rejected"), F.min_by("refused", "priority").alias("refused"))
    rows = got.select("page_id", "fetcher", "status", "error").join(tries, "page_id", "left")
    return rows.select("page_id", "refused", "fetcher", "status", "error", F.coalesce("rejected", F.lit(0)).alias("rejected"))


@query(
    """SELECT n_name AS name, count(*) AS requests, count(*) FILTER (WHERE c_acctbal >= 0) AS found FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""
)
def corpus_fetch(spark, sf_dir):
    from ..sources.fetch import requests

    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    url = cat("http://", F.col("n_nationkey"), ".example/", F.col("c_custkey"))
    asked = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(url.alias("url"), "n_name", "c_acctbal")
    stored = asked.where("c_acctbal >= 0").select("url", F.lit("<p>x</p>").alias("html"))
    got = CorpusFetcher(stored).fetch(requests(asked)).join(asked, "url")
    return got.groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("requests"), F.count_if(F.col("error").isNull()).alias("found"))


@query(
    """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""
)
def event_windows(spark, sf_dir):
    from ..streaming.crawl_state import event_counts

    events = table(spark, sf_dir, "events")
    kind = "timestamp_ntz" if dict(events.dtypes)["ts"] == "timestamp_ntz" else "timestamp"
    found = event_counts(events.withColumn("ts", F.col("ts").cast("timestamp")))
    return found.select(F.col("window_start").cast(kind).alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query()
def readable_article(spark, sf_dir):
    found = extract(pages(spark, sf_dir), "article").select("page_id", "article.*")
    return found.select("page_id", "title", F.sha2("content", 256).alias("content_sha256"), F.length("content").alias("length"), "author", "date")


@query()
def readable_content(spark, sf_dir):
    found = extract(pages(spark, sf_dir), body=readable("article"), first=first_text("article"))
    return found.select("page_id", F.length("body").alias("readable_length"), F.length("first").alias("selected_length"))


@query()
def fingerprints(spark, sf_dir):
    return extract(pages(spark, sf_dir), "fingerprint").select("page_id", "fingerprint.*")


@query()
def page_text(spark, sf_dir):
    found = parse_pages(pages(spark, sf_dir)).select("page_id", "text.*")
    return found.drop("raw_text", "cleaned_text").withColumn("reading_time_minutes", F.round("reading_time_minutes", 6))


@query(
    f"""SELECT host, page_id, lag(page_id) OVER w AS before, row_number() OVER w AS turn FROM (SELECT page_id, {HOST} AS host FROM pages)
    WINDOW w AS (PARTITION BY host ORDER BY page_id)"""
)
def host_neighbours(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select(urls.url_host(F.col("url")).alias("host"), "page_id")
    turns = written(row_numbers(found, "host", ["page_id"]), "turns")
    before = turns.select(F.col("host").alias("_host"), (F.col("turn") + 1).alias("_turn"), F.col("page_id").alias("before"))
    return turns.join(before, F.col("host").eqNullSafe(F.col("_host")) & (F.col("turn") == F.col("_turn")), "left").select(
        "host", "page_id", "before", "turn"
    )
