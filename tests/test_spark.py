import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagelake.functions import kinds, responses, text, urls
from pagelake.plans import article_links, records
from pagelake.plans import queries as own
from pagelake.plans.config import CrawlConfig, DownloadConfig, FetchConfig, LimitRule, MediaConfig, ParserConfig, UrlRule
from pagelake.plans.crawl import Crawler, Hooks, matching_rule, schedule, stats
from pagelake.plans.parse import FEATURES, extract, parse_pages
from pagelake.sources.download import MediaDownloader
from pagelake.sources.fetch import CallableFetcher, CompositeFetcher, CorpusFetcher, abort, default_headers, requests, with_header
from pagelake.streaming import crawl_state


@pytest.mark.parametrize("name", list(own.SQL))
def test_query_equals_sql(spark, sf_dir, same, name):
    same(own.QUERIES[name](spark, sf_dir), own.SQL[name])


@pytest.mark.parametrize("name", [n for n in own.QUERIES if n not in own.SQL])
def test_query_runs(spark, sf_dir, name):
    assert own.QUERIES[name](spark, sf_dir).count() > 0


def test_responses_are_whole_pages(spark, tmp_path):
    """Marks after character 2000 count, and the size is that of the whole page."""
    filler = "<html>" + "x" * 6_000
    rows = [(11, filler), (23, filler + "Access Denied errors.edgesuite.net"), (35, "<html>"), (34, filler + "px-captcha"), (22, filler),
            (27, filler + "not allowed"), (15, "<html>" + "y" * 2_500 + "not allowed"), (3, filler + "cloudflare denied"), (44, filler + "px-captcha"), (32, filler)]
    pages = [(k, f"http://h/{k}", html) for k, html in rows]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.challenge, r.denied) for r in own.QUERIES["response_detectors"](spark, str(tmp_path)).collect()}
    no = (False, False)
    assert got == {11: no, 23: (False, True), 35: no, 34: (True, False), 22: no, 27: no, 15: (False, True), 3: (False, True), 44: (True, False), 32: no}
    first = {r.page_id: (r.fetcher, r.refused) for r in own.QUERIES["composite_failover"](spark, str(tmp_path)).collect()}
    assert first[44] == ("second", "bot_challenge") and first[32] == ("first", None) and first[35] == (None, "http: not found")


def test_failover_keeps_pages_of_one_url_apart(spark, tmp_path):
    import duckdb

    rows = [(k, f"http://h/{k % 3}", "<html>" + "px-captcha" * (k % 7 == 0)) for k in range(1, 61)]
    path = f"{tmp_path}/pages.parquet"
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(path)
    got = own.QUERIES["composite_failover"](spark, str(tmp_path)).toPandas().astype(object)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.execute(own.SQL["composite_failover"]).df().astype(object)
    rows_of = lambda df: sorted(map(repr, df[sorted(df.columns)].fillna("-").replace({200.0: 200, 403.0: 403}).itertuples(index=False, name=None)))
    assert len(got) == 60 and rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["page_id", "url", "text", "score", "cluster_size"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.lit(1)])
    return df.select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, text.strip_tags(t), t="a <b>c</b> > d <unclosed") == "a c d"
    assert one(spark, text.collapse_newlines(t), t="\n a\n\n\n\nb \n") == "a\n\nb"
    assert one(spark, text.normalise(t), t=" a  b\n") == "a b"
    assert one(spark, text.count_sentences(t), t="") == 1 and one(spark, text.count_words(t), t="a 1 b2 --") == 2
    words = {"the": 1, "table": 2, "makes": 1, "created": 1, "queue": 1, "über": 1, "rhythm": 1, "apple": 2, "x": 1, "'--": 0}
    assert {w: one(spark, text.count_syllables(t), t=w) for w in words} == words
    assert one(spark, text.detect_language(t), t="le monde est dans la nuit pour vous") == "fr" and one(spark, text.detect_language(t), t="zz") is None
    assert one(spark, text.detect_language(t), t="entre") == "es"
    assert one(spark, text.clean_text(t), t="a\x00b\tc\x07") == "ab\tc" and one(spark, text.truncate_text(t, 5), t="abcdef") == "ab..."
    assert one(spark, text.flesch_reading_ease(t), t="") == 0.0 and one(spark, text.flesch_kincaid_grade(t), t="Go on.") == 0.0


def test_url_functions(spark):
    u = F.col("u")
    assert one(spark, urls.url_host(u), u="https://U:p@Ex.com:80/x") == "ex.com" and one(spark, urls.url_host(u), u="x") is None
    assert one(spark, urls.domain_allowed(u, ["a.com"], ["b.a.com"]), u="http://c.b.a.com/") is False
    assert one(spark, urls.domain_allowed(u, ["a.com"]), u="nohost") is True and one(spark, urls.domain_allowed(u, ["a.com"]), u="http://xa.com") is False
    assert one(spark, urls.url_allowed(u, ["("], ["z"]), u="abc") is True and one(spark, urls.url_allowed(u, ["q"]), u="abc") is False
    assert one(spark, urls.page_url(u, F.lit(3)), u="http://x/page/2/") == "http://x/page/3" and one(spark, urls.page_url(u, F.lit(3)), u="http://x/?a=1#f") == "http://x/?a=1&page=3#f"
    assert one(spark, urls.filename(u), u="http://x/a/b%20c.pdf?q") == "b_20c.pdf" and one(spark, urls.filename(u), u="http://x/").startswith("download_")
    assert one(spark, urls.link_type(u, F.lit("http://b.com")), u="http://a.b.com/") == "internal"
    assert one(spark, urls.resolve_url(u, F.lit("http://b.com/x/")), u="../y") == "http://b.com/y" and one(spark, urls.normalise_url(u), u="http://B.com:80#f") == "http://b.com/"
    assert tuple(one(spark, urls.page_info(u), u="Page 2 of 9")) == (2, 9, None)


def test_kinds(spark):
    u = F.col("u")
    assert one(spark, kinds.video_id(u), u="https://youtu.be/abcdefghijk") == "abcdefghijk"
    assert one(spark, kinds.thumbnail(u), u="https://dai.ly/x") is None and one(spark, kinds.media_type(F.lit("video/mp4"), u), u="x") == "video"
    assert one(spark, kinds.media_type(F.lit(None).cast("string"), u), u="http://x/a.png?x") == "other" and one(spark, kinds.image_mime(kinds.image_format(u)), u="JPG") == "image/jpeg"
    assert one(spark, kinds.feed_type(u), u='<?xml?><rss version="2.0">') == "rss2" and one(spark, kinds.feed_type(u), u="<feed>") == "atom"
    assert one(spark, kinds.valid_email(u), u="a@b.c.d.org") is False and one(spark, kinds.valid_email(u), u="joe@x.org") is True
    assert one(spark, kinds.social_platform(u), u="https://GitHub.com/x") == "git_hub" and one(spark, kinds.user_agent(u), u="x").startswith("Mozilla")
    assert one(spark, kinds.media_type_of_mime(u), u="application/vnd.ms-presentation") == "document" and one(spark, kinds.is_placeholder(u, F.lit(1), F.lit(1)), u="x") is True


def test_features_of_null_and_empty_pages(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "http://x/"), (3, "<p>x", None)], "page_id int, html string, url string")
    rows = {r.page_id: r for r in extract(df, *FEATURES).collect()}
    assert rows[1].links is None and rows[2].links == [] and rows[3].paragraphs == [] and rows[2].metadata.title is None
    parsed = parse_pages(df, ParserConfig.minimal()).collect()
    assert parsed[1].images == [] and parsed[0].text is None
    assert parse_pages(df, ParserConfig.full().add_content_selector(".x")).where("page_id = 3").first().text.word_count == 1
    assert parse_pages(df, fragment=True).columns.count("metadata") == 0


def test_pages_are_parsed_once(spark, sf_dir, capsys):
    own.QUERIES["forms"](spark, sf_dir).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_article_links_keeps_the_best_row(spark):
    html = "<ul>" + "".join(f"<li><a href=/news/{k}/story>A long headline number {k}</a></li>" for k in range(4)) + "</ul><a href=/news/0/story>short</a><a href=/login>login</a>"
    df = spark.createDataFrame([(1, html, "http://x.example/")], "page_id int, html string, url string")
    got = {r.url: r for r in article_links.article_links(df).collect()}
    assert len(got) == 4 and got["http://x.example/news/0/story"].text.startswith("A long") and got["http://x.example/news/1/story"].score == 3.8
    rule = UrlRule().with_include("/login")
    assert article_links.article_links(df, rule=rule).count() == 4


SITE = [
    ("http://s/", "<a href=/a>a</a><a href='/b'>b</a><a href=/a#f>f</a>"), ("http://s/a", "<a href=/c>c</a>"), ("http://s/b", "<html>px-captcha <a href=/d>d</a>"),
    ("http://s/c", "<p>end"), ("http://s/a#f", "x"),
]


@pytest.fixture(scope="module")
def site(spark):
    return CorpusFetcher(spark.createDataFrame(SITE, "url string, html string"))


def test_crawl_depth_and_detectors(spark, site):
    got = {r.url: (r.depth, r.refused) for r in Crawler(spark, site, CrawlConfig(follow_links=True, max_depth=1)).visit("http://s/").collect()}
    assert got == {"http://s/": (0, None), "http://s/a": (1, None), "http://s/a#f": (1, None), "http://s/b": (1, "bot_challenge")}
    deep = Crawler(spark, site, CrawlConfig(follow_links=True, detect_bot_challenge=False))
    assert {r.url for r in deep.visit("http://s/").where("refused is null").collect()} == {u for u, _ in SITE}
    assert deep.visit("http://s/").count() == 0 and deep.fresh().visit("http://s/").count() == 6  # the missing /d is an error row
    assert Crawler(spark, site, CrawlConfig().add_disallowed_url_filter("s/").add_url_filter("(")).visit("http://s/").count() == 0
    assert stats(deep.fresh().visit("http://s/")).agg(F.sum("success")).first()[0] == 5


def test_crawl_hooks(spark, site):
    seen = {"el": 0, "err": 0, "html": 0, "done": 0}

    def count(key):
        return lambda df: seen.__setitem__(key, seen[key] + df.count())

    hooks = Hooks(on_error=count("err"), on_html=count("html"), on_scraped=count("done"), on_request=lambda df: abort(df, F.col("url").endswith("/c")))
    hooks.on_element("a[href]", count("el"))
    hooks.on_element("//a", count("el"), "xpath")
    hooks.detach("//a", "xpath")
    Crawler(spark, site, CrawlConfig(follow_links=True), hooks).visit("http://s/").count()
    assert seen == {"el": 4, "err": 1, "html": 3, "done": 3}
    got = Crawler(spark, site).run_with_results(["http://s/", "http://none/"]).collect()
    assert [(r.seed_idx, r.status) for r in got] == [(0, "success"), (1, "failed")]


def test_crawl_reads(spark, site):
    df = spark.createDataFrame([("http://s/",), ("http://s/c",)], "url string")
    assert {r.url: r.links for r in Crawler(spark, site).get_links(df, "a").collect()}["http://s/"] == ["http://s/a", "http://s/b", "http://s/a#f"]
    assert {r.url: r.links for r in Crawler(spark, site).get_links(df, "//a/@href", "xpath").collect()}["http://s/c"] == []
    assert Crawler(spark, site).get_articles(df).count() == 2
    feed = CorpusFetcher(spark.createDataFrame([("http://f", "<rss><link>http://f/1</link></rss>"), ("http://j", '{"version":"https://jsonfeed.org/1"}')], "url string, html string"))
    got = {r.url: r for r in Crawler(spark, feed).get_feed_links(spark.createDataFrame([("http://f",), ("http://j",)], "url string")).collect()}
    assert got["http://f"].links == ["http://f/1"] and got["http://j"].error


def test_fetchers_and_failover(spark):
    calls = spark.sparkContext.accumulator(0)

    def get(url, method, headers, body):
        calls.add(1)
        if url.endswith("bad"):
            raise OSError("down")
        return 200, {"Content-Type": "text/html", "X": headers.get("h", "")}, "<html>" + ("px-captcha" if url.endswith("bot") else "ok"), None

    asked = default_headers(with_header(requests(spark.createDataFrame([("u1",), ("u/bad",), ("u/bot",)], "url string")), "h", "1"), {"h": "2", "z": "3"})
    live = CallableFetcher(get, FetchConfig(max_retries=1), wait_s=0)
    got = {r.url: r for r in live.fetch(asked).collect()}
    assert got["u1"].response_headers["x"] == "1" and got["u/bad"].error.endswith("down") and calls.value == 4
    spare = CorpusFetcher(spark.createDataFrame([("u/bot", "<html>fine")], "url string, html string"), name="spare")
    both = CompositeFetcher([live, spare])
    got = {r.url: (r.fetcher, r.error) for r in both.fetch(asked).collect()}
    assert got["u1"] == ("http", None) and got["u/bot"] == ("spare", None) and got["u/bad"][1] == "all fetchers failed: http: not found"
    assert len(both) == 2 and both.attempts(asked).count() == 3
    assert CompositeFetcher([]).fetch(asked).first().error == "no fetcher configured"
    assert live.fetch(abort(asked, F.lit(True))).count() == 0


def test_downloads(spark, tmp_path):
    def get(url):
        if url.endswith("404"):
            return 404, None, None, b""
        return 200, "image/png", 99 if url.endswith("big") else None, b"data"

    df = spark.createDataFrame([("http://x/a.png",), ("http://x/404",), ("http://x/big",)], "url string")
    d = MediaDownloader(get, DownloadConfig(max_file_size=50, max_retries=1, retry_delay_ms=1, encode_base64=True))
    got = {r.url[-3:]: r for r in d.download(df).collect()}
    assert got["png"].hash == "3a6eb0790f39ac87c94f3856b2dd2c5d110e6811602261a9a923d3bb23adc8b7" and got["png"].base64 == "ZGF0YQ=="
    assert got["404"].error == "http: 404" and got["big"].error == "file too large: 99" and got["big"].bytes is None
    saved = {r.url[-3:]: r.path for r in d.download_to_dir(df, str(tmp_path)).collect()}
    assert open(saved["png"], "rb").read() == b"data" and saved["404"] is None


def test_limits(spark):
    rules = (LimitRule("*.a.com", 2, 3.0), LimitRule())
    hosts = matching_rule(spark.createDataFrame([("x.a.com",), ("b",)], "host string"), rules)
    assert {r.host: r.rule_order for r in hosts.collect()} == {"x.a.com": 0, "b": 1}
    df = spark.createDataFrame([(k, f"http://x.a.com/{k}") for k in range(5)], "seq int, url string")
    assert [r.start_s for r in schedule(df, rules).orderBy("seq").collect()] == [0.0, 0.0, 3.0, 3.0, 6.0]


def test_record_accessors(spark):
    html = "<form action=/login><input type=password name=p><input type=hidden name=h></form><div class=pager><a href=/p/1>1</a><a href=/p/2>2</a></div><link rel=next href=/p/2>"
    df = spark.createDataFrame([(html, "http://x/")], "html string, url string")
    r = extract(df, "forms", "pagination", "contacts", "feeds", "amp").select(
        records.has_form(F.col("forms"), "login").alias("a"), F.size(records.visible_fields(F.col("forms")[0])).alias("b"),
        records.field_named(F.col("forms")[0], "p")["field_type"].alias("c"), F.size(records.numbered_pages(F.col("pagination"))).alias("d"),
        records.paginated(F.col("pagination")).alias("e"), records.has_contact_info(F.col("contacts")).alias("f"),
        records.first_feed(F.col("feeds"), "atom").alias("g"), F.size(records.forms_of(F.col("forms"), "search")).alias("h"),
        F.size(records.input_fields(F.col("forms")[0])).alias("i"),
    ).first()
    assert tuple(r) == (True, 1, "password", 1, True, False, None, 0, 1)
    assert MediaConfig.minimal().extract_videos is False and MediaConfig.full().include_data_urls


def test_responses(spark):
    h = F.create_map(F.lit("content-type"), F.lit("text/html"))
    b, s = F.col("b"), F.lit(200)
    assert one(spark, responses.is_bot_challenge(s, h, b), b="DataDome") is True and one(spark, responses.is_bot_challenge(F.lit(503), h, b), b="DataDome") is False
    assert one(spark, responses.is_html(F.lit(None).cast("map<string,string>"), b), b="  <!DOCTYPE HTML>") is True
    assert one(spark, responses.is_access_denied(F.lit(403), h, b), b="403 Forbidden" + "x" * 4000) is False
    assert one(spark, responses.challenge_vendor(b), b="Akamai robot") == "akamai"


def test_streams(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.unionByName(pages.limit(10)).repartition(3).write.parquet(str(tmp_path / "in"))

    def drain(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    stream = crawl_state.page_stream(spark, str(tmp_path / "in"))
    assert drain(crawl_state.first_visits(stream), "visits").count() == pages.count()
    plan = drain(crawl_state.polite(stream.selectExpr("url", "page_id AS seq"), delay_s=2.0), "plan")
    assert plan.count() == pages.count() + 10 and plan.groupBy("host", "start_s").count().where("count > 1").count() == 0
    timed = stream.selectExpr("url", "timestamp_seconds(page_id) AS ts")
    assert drain(crawl_state.host_rates(timed, "url", "ts"), "rates", "complete").agg(F.sum("pages")).first()[0] == pages.count() + 10
