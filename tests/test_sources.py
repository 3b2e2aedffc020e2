"""Call counts, redirects, concurrency, waiting, one-shot downloads."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from pagelake.plans.config import CrawlConfig, DownloadConfig, FetchConfig, LimitRule
from pagelake.plans.crawl import Crawler, schedule
from pagelake.sources import download
from pagelake.sources.fetch import BrowserFetcher, CallableFetcher, CompositeFetcher, http_get, requests
from pagelake.sources.parallel import in_threads

HTML = {"content-type": "text/html"}


def counted(spark, answers):
    """A transport over answers by URL, and a count of its calls."""
    calls = spark.sparkContext.accumulator(0)

    def get(url, method, headers, body):
        calls.add(1)
        status, text = answers[url]
        if status is None:
            raise OSError(text)
        return status, HTML, text, url

    return get, calls


def test_each_tier_gets_a_request_once(spark):
    urls = ["ok", "late", "last", "never", "bot"]
    first = {u: (200, "<html>1") if u == "ok" else (200, "<html>px-captcha") if u == "bot" else (None, "down") for u in urls}
    second = {u: (200, "<html>2") if u in ("late", "bot") else (None, "off") for u in urls}
    third = {u: (200, "<html>3") if u == "last" else (403, "<html>access denied") for u in urls}
    tiers, counts = [], []
    for k, answers in enumerate((first, second, third)):
        get, calls = counted(spark, answers)
        tiers.append(CallableFetcher(get, FetchConfig(max_retries=0, name=f"t{k}")))
        counts.append(calls)
    asked = requests(spark.createDataFrame([(u,) for u in urls], "url string"))
    got, log = CompositeFetcher(tiers).fetch_logged(asked)
    for _ in range(2):  # whatever is read, and however often
        rows = {r.url: (r.fetcher, r.status, r.response_body, r.error) for r in got.collect()}
        tries = sorted((r.url, r.priority, r.refused) for r in log.collect())
    assert [c.value for c in counts] == [5, 4, 2]
    assert rows == {
        "ok": ("t0", 200, "<html>1", None), "late": ("t1", 200, "<html>2", None), "bot": ("t1", 200, "<html>2", None), "last": ("t2", 200, "<html>3", None),
        "never": (None, None, None, "all fetchers failed: access_denied"),
    }
    assert tries == [("bot", 0, "bot_challenge"), ("last", 0, "http: down"), ("last", 1, "http: off"), ("late", 0, "http: down"),
                     ("never", 0, "http: down"), ("never", 1, "http: off"), ("never", 2, "access_denied")]


def test_composite_details(spark):
    asked = requests(spark.createDataFrame([("a",), ("b",)], "url string"))
    get, calls = counted(spark, {"a": (200, "<html>px-captcha"), "b": (200, "<html>odd words")})
    plain = CompositeFetcher([CallableFetcher(get)], detect_bot_challenge=False)
    assert plain.fetch(asked).where("error is null").count() == 2
    odd = CompositeFetcher([CallableFetcher(get)], on_denied=lambda s, h, b: b.contains("odd"))
    assert {r.url: r.refused for r in odd.attempts(asked).collect()} == {"a": "bot_challenge", "b": "access_denied"}
    none, log = CompositeFetcher([]).fetch_logged(asked)
    assert none.count() == 2 and log.count() == 0
    gone = asked.withColumn("aborted", F.lit(True))
    before = calls.value
    assert plain.fetch(gone).count() == 0 and calls.value == before


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            kind, _, n = self.path[1:].partition("/")
            if kind == "hop" and int(n) > 0:
                self.send_response(302)
                self.send_header("Location", f"/hop/{int(n) - 1}")
                self.end_headers()
                return
            self.send_response(200)
            self.send_header("Content-Type", "image/png" if kind == "file" else "text/html")
            data = b"x" * int(n or 0) if kind == "file" else (self.headers.get("user-agent") or "").encode()
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_redirects_are_limited(server):
    get = http_get(FetchConfig(max_redirects=3))
    assert get(f"{server}/hop/3", "GET", {}, None)[0] == 200
    with pytest.raises(OSError):
        get(f"{server}/hop/4", "GET", {}, None)
    with pytest.raises(OSError):
        http_get(FetchConfig(max_redirects=0))(f"{server}/hop/1", "GET", {}, None)


def test_live_downloads(spark, server, tmp_path):
    get = download.http_download(DownloadConfig(user_agent="tester", max_file_size=100))
    assert get(f"{server}/who")[3] == b"tester" and len(get(f"{server}/file/500")[3]) == 101
    urls = spark.createDataFrame([(f"{server}/file/{n}",) for n in (3, 50, 500)], "url string")
    got = {r.url.rsplit("/", 1)[1]: r for r in download.MediaDownloader(config=DownloadConfig(max_file_size=100, max_retries=0)).download(urls).collect()}
    assert got["3"].bytes == b"xxx" and got["50"].size == 50 and got["500"].error == "file too large: 500" and got["3"].media_type == "image"
    assert download.download_bytes(f"{server}/file/4") == b"xxxx" and download.download_to_base64(f"{server}/file/1") == "eA=="
    data, digest = download.download_with_hash(f"{server}/file/2")
    assert data == b"xx" and digest == "5dde896887f6754c9b15bfe3a441ae4806df2fde94001311e08bf110622e0bbe"
    path = download.save_to_file(data, str(tmp_path / "new"), "f.bin")
    assert open(path, "rb").read() == data
    with pytest.raises(OSError):
        download.MediaDownloader(lambda u: (404, None, None, b""), DownloadConfig(max_retries=0)).one("u")


def test_calls_of_a_task_overlap(spark):
    def call(k):
        time.sleep(0.2)
        return k * 2, {"k": str(k)}

    df = spark.range(24, numPartitions=1).withColumn("keep", F.lit("x"))
    began = time.time()
    rows = in_threads(df, call, ["id"], "twice long, m map<string,string>", 12).collect()
    assert time.time() - began < 4 and [r.twice for r in rows] == [2 * k for k in range(24)] and rows[5].m == {"k": "5"} and rows[0].keep == "x"


def test_concurrency_is_bounded_over_all_tasks(spark, tmp_path):
    mark = str(tmp_path)

    def get(url, method, headers, body):
        import os
        import uuid

        mine = os.path.join(mark, uuid.uuid4().hex)
        open(mine, "w").close()
        n = len(os.listdir(mark))
        time.sleep(0.05)
        os.remove(mine)
        return 200, HTML, str(n), url

    asked = requests(spark.range(40).selectExpr("concat('u', id) AS url")).repartition(8)
    got = CallableFetcher(get).limited(2).fetch(asked).collect()
    assert len(got) == 40 and max(int(r.response_body) for r in got) <= 2
    assert CrawlConfig().concurrency == 16 and CrawlConfig(limits=(LimitRule("a", 3), LimitRule("b", 5))).concurrency == 5 and CrawlConfig(max_concurrency=2).concurrency == 2


def test_schedule_with_random_delay(spark):
    df = spark.range(30).selectExpr("concat('http://h/', id) AS url", "id AS seq")
    starts = sorted(r.start_s for r in schedule(df, (LimitRule("h", 3, 2.0, 1.0),)).collect())
    batches = [starts[k : k + 3] for k in range(0, 30, 3)]
    assert batches[0] == [0.0] * 3
    for a, b in zip(batches, batches[1:]):
        assert min(b) - max(a) >= 2.0 - 1e-9
    assert {r.start_s for r in schedule(df, (LimitRule("other", 1, 9.0),)).collect()} == {0.0}


def test_a_crawl_waits_for_hosts_with_a_rule(spark):
    def get(url, method, headers, body):
        return 200, HTML, f"{time.time()}", url

    df = spark.createDataFrame([(f"http://{h}/{k}",) for h in ("slow.example", "free.example") for k in range(4)], "url string")
    config = CrawlConfig(limits=(LimitRule("slow*", 1, 0.3),))
    got = {r.url: float(r.response_body) for r in Crawler(spark, CallableFetcher(get), config).crawl(df).collect()}
    slow = sorted(t for u, t in got.items() if "slow" in u)
    assert len(got) == 8 and all(b - a >= 0.25 for a, b in zip(slow, slow[1:]))


def test_browser_headers(spark):
    def get(url, method, headers, body):
        return 200, HTML, "|".join(f"{k}={headers.get(k)}" for k in ("accept-language", "sec-fetch-mode", "user-agent")), url

    asked = requests(spark.createDataFrame([("a",)], "url string")).withColumn("headers", F.create_map(F.lit("accept-language"), F.lit("de")))
    got = BrowserFetcher(get).fetch(asked).first()
    assert got.response_body.startswith("accept-language=de|sec-fetch-mode=navigate|user-agent=Mozilla/5.0") and got.fetcher == "browser"
    assert BrowserFetcher(get).limited(1).fetch(asked).count() == 1


def test_logs(monkeypatch, capsys):
    from pagelake.plans import logs

    assert logs.init_debug().isEnabledFor(10) and len(logs.init_with_timestamp("warning").handlers) == 1
    monkeypatch.setenv(logs.VARIABLE, "error")
    assert logs.init_with_env().level == 40
    monkeypatch.setenv(logs.VARIABLE, "nonsense")
    assert logs.init_with_env().level == 20
