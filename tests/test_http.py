import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from pagelake.plans.config import FetchConfig
from pagelake.sources.datasource import register
from pagelake.sources.fetch import CallableFetcher, http_get, page_reader, requests


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/ok")
                self.end_headers()
                return
            self.send_response(404 if self.path == "/none" else 200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(f"<p>é {self.headers.get('user-agent', '')[:7]}".encode())

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_live_fetch(spark, server):
    urls = [f"{server}/ok", f"{server}/moved", f"{server}/none", "http://127.0.0.1:9/closed"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    config = FetchConfig(max_retries=1, timeout_secs=5)
    got = {r.url.rsplit("/", 1)[1]: r for r in CallableFetcher(http_get(config), config, wait_s=0).fetch(requests(df)).collect()}
    assert got["ok"].status == 200 and got["ok"].response_body == "<p>é Mozilla" and got["ok"].response_headers["content-type"].startswith("text/html")
    assert got["moved"].final_url.endswith("/ok") and got["none"].status == 404 and got["none"].error is None and got["closed"].error.startswith("http: ")


def test_data_source(spark, server):
    register(spark)
    urls = [f"{server}/ok", f"{server}/none", "http://127.0.0.1:9/closed"]
    read = spark.read.format("http_pages").option("urls", json.dumps(urls)).option("retries", "0").option("partitions", "2").option("timeout", "5")
    got = {r.url: (r.status, r.error is None) for r in read.load().collect()}
    assert got == {urls[0]: (200, True), urls[1]: (404, True), urls[2]: (None, False)}


def test_stored_pages(spark, tmp_path):
    df = spark.createDataFrame([("u", "<p>")], "url string, html string")
    for kind in ("json", "csv", "orc", "parquet"):
        df.write.format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(str(tmp_path / f"p.{kind}"))
        assert tuple(page_reader(spark, str(tmp_path / f"p.{kind}")).select("url", "html").first()) == ("u", "<p>")
