"""Requests, fetchers and failover. A fetcher maps a DataFrame of requests to one of responses:
the requests' columns and status INT, headers MAP, body STRING, final_url STRING, fetcher STRING, error STRING."""

from __future__ import annotations

import time
from typing import Callable, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import responses as r
from ..functions.kinds import user_agent
from ..plans.config import FetchConfig
from ..plans.shared import written
from .parallel import in_threads

REQUEST = (
    "url string, method string, headers map<string,string>, allow_revisit boolean, context map<string,string>, "
    "body binary, aborted boolean, depth int"
)
RESPONSE = "status int, headers map<string,string>, body string, final_url string, error string"


def requests(urls: DataFrame, url: str = "url", method: str = "GET", body: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """A request per row; other columns than ``keys`` go. Keys tell requests for one URL apart."""
    none = F.lit(None)
    return urls.select(
        *keys,
        F.col(url).alias("url"), F.lit(method).alias("method"), F.create_map().cast("map<string,string>").alias("headers"),
        F.lit(False).alias("allow_revisit"), F.create_map().cast("map<string,string>").alias("context"),
        (body if body is not None else none).cast("binary").alias("body"), F.lit(False).alias("aborted"), F.lit(0).alias("depth"),
    )


def with_header(df: DataFrame, name: str, value: str, column: str = "headers") -> DataFrame:
    """Set an entry of the headers (or of ``context``); a later value wins."""
    kept = F.map_filter(F.col(column), lambda k, v: k != name)
    return df.withColumn(column, F.map_concat(kept, F.create_map(F.lit(name), F.lit(value))))


def default_headers(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Fill in headers that a request lacks."""
    for k, v in headers.items():
        mine = F.map_contains_key("headers", F.lit(k))
        df = df.withColumn("headers", F.when(mine, F.col("headers")).otherwise(F.map_concat("headers", F.create_map(F.lit(k), F.lit(v)))))
    return df


def abort(df: DataFrame, when: Column) -> DataFrame:
    """Mark requests as aborted; they are never sent."""
    return df.withColumn("aborted", F.col("aborted") | F.coalesce(when, F.lit(False)))


class Fetcher(Protocol):
    name: str

    def fetch(self, requests: DataFrame) -> DataFrame: ...


class CorpusFetcher:
    """Answers from a table of stored pages by an equi-join on the URL; a page that isn't there is an error row.

    A store that holds several pages of one URL needs ``keys``: columns of requests and pages that must agree as well.
    """

    def __init__(
        self, pages: DataFrame, url: str = "url", html: str = "html", status: str | None = None, headers: str | None = None, name: str = "corpus",
        keys: tuple[str, ...] = (),
    ):
        self.name, self.keys = name, keys
        kind = F.create_map(F.lit("content-type"), F.lit("text/html"))
        self.pages = pages.select(
            *(F.col(k).alias(f"_key_{k}") for k in keys), F.col(url).alias("_url"), F.col(html).alias("_body"), (F.col(status) if status else F.lit(200)).cast("int").alias("_status"),
            (F.col(headers) if headers else kind).alias("_headers"),
        )

    def fetch(self, requests: DataFrame) -> DataFrame:
        same = F.col("url") == F.col("_url")
        for k in self.keys:
            same &= F.col(k) == F.col(f"_key_{k}")
        found = requests.where(~F.col("aborted")).join(self.pages, same, "left")
        missing = F.col("_url").isNull()
        return found.select(
            *requests.columns, F.col("_status").alias("status"), F.col("_headers").alias("response_headers"),
            F.col("_body").alias("response_body"), F.when(~missing, F.col("url")).alias("final_url"),
            F.lit(self.name).alias("fetcher"), F.when(missing, "http: not found").alias("error"),
        )


class CallableFetcher:
    """Calls ``get(url, method, headers, body) -> (status, headers, body, final_url)`` in the workers, ``config.max_concurrent`` at once in a task.

    A request with a ``start_s`` isn't sent before so many seconds after its task began. Transport errors are retried with exponential backoff, HTTP statuses aren't; what still fails is an error row.
    """

    def __init__(self, get: Callable | None = None, config: FetchConfig = FetchConfig(), wait_s: float = 0.1):
        self.get, self.config, self.wait_s, self.name = get or http_get(config), config, wait_s, config.name
        self.total: int | None = None

    def limited(self, total: int) -> CallableFetcher:
        """The same fetcher with at most ``total`` requests under way in all tasks together."""
        other = type(self)(self.get, self.config, self.wait_s)
        other.total = total
        return other

    def fetch(self, requests: DataFrame) -> DataFrame:
        get, retries, wait = self.get, self.config.max_retries, self.wait_s
        names = requests.columns
        agent = user_agent(F.col("url"), self.config.user_agent)
        if self.config.random_user_agent or self.config.user_agent:
            mine = F.map_contains_key("headers", F.lit("user-agent"))
            requests = requests.withColumn(
                "headers", F.when(mine, F.col("headers")).otherwise(F.map_concat("headers", F.create_map(F.lit("user-agent"), agent)))
            )

        threads = self.config.max_concurrent
        if self.total is not None:
            tasks = max(1, min(self.total, requests.sparkSession.sparkContext.defaultParallelism))
            requests, threads = requests.coalesce(tasks), max(1, min(threads, self.total // tasks))
        began: list[float] = []

        def call(url, method, headers, body, start=None):
            if start is not None:
                began or began.append(time.monotonic())
                time.sleep(max(0.0, began[0] + start - time.monotonic()))
            for k in range(retries + 1):
                try:
                    status, said, text, final = get(url, method, dict(headers or {}), body)
                    return status, {str(a).lower(): b for a, b in said.items()}, text, final or url, None
                except Exception as e:
                    error = f"http: {e}"
                    if k < retries:
                        time.sleep(wait * 2**k)
            return None, None, None, None, error

        answer = "status int, response_headers map<string,string>, response_body string, final_url string, error string"
        args = ["url", "method", "headers", "body", *(["start_s"] if "start_s" in names else [])]
        sent = in_threads(requests.where(~F.col("aborted")), call, args, answer, threads)
        return sent.select(
            *names, "status", "response_headers", "response_body", "final_url", F.lit(self.name).alias("fetcher"), "error"
        )


def http_get(config: FetchConfig = FetchConfig()) -> Callable:
    """A transport for CallableFetcher over the standard library; more than ``config.max_redirects`` redirects are an error."""

    def get(url, method, headers, body):
        import urllib.error
        import urllib.request

        class Redirects(urllib.request.HTTPRedirectHandler):
            max_repeats = max_redirections = config.max_redirects

            def http_error_302(self, request, fp, code, msg, headers):
                if len(getattr(request, "redirect_dict", {})) >= config.max_redirects:
                    raise OSError("too many redirects")
                return super().http_error_302(request, fp, code, msg, headers)

            http_error_301 = http_error_303 = http_error_307 = http_error_308 = http_error_302

        handlers = [Redirects()]
        if config.proxy_url:
            auth = f"{config.proxy_user}:{config.proxy_pass}@" if config.proxy_user else ""
            scheme, _, rest = config.proxy_url.partition("://")
            handlers.append(urllib.request.ProxyHandler({k: f"{scheme}://{auth}{rest}" for k in ("http", "https")}))
        request = urllib.request.Request(url, data=bytes(body) if body is not None else None, headers=headers, method=method)
        try:
            answer = urllib.request.build_opener(*handlers).open(request, timeout=config.timeout_secs)
        except urllib.error.HTTPError as e:
            answer = e
        with answer:
            kind = answer.headers.get_content_charset() or "utf-8"
            return answer.status, dict(answer.headers.items()), answer.read().decode(kind, "replace"), answer.geturl()

    return get


#: What a browser sends besides its name.
BROWSER_HEADERS = {
    "accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "accept-language": "en-US,en;q=0.9", "upgrade-insecure-requests": "1",
    "sec-fetch-dest": "document", "sec-fetch-mode": "navigate", "sec-fetch-site": "none", "sec-fetch-user": "?1",
}


class BrowserFetcher(CallableFetcher):
    """A second HTTP backend that sends a browser's headers with its name; a request's own headers win.

    Only headers are a browser's: the standard library can't shake hands as one does.
    """

    def __init__(self, get: Callable | None = None, config: FetchConfig = FetchConfig(name="browser"), wait_s: float = 0.1):
        super().__init__(get, config, wait_s)

    def fetch(self, requests: DataFrame) -> DataFrame:
        return super().fetch(default_headers(requests, BROWSER_HEADERS))


def refusal(bot: bool = True, denied: bool = True, more_bot=None, more_denied=None) -> Column:
    """Why a response isn't accepted, null if it is: built-in detectors first, then given predicates."""
    seen = (F.col("status"), F.col("response_headers"), F.col("response_body"))
    out = F.when(F.col("error").isNotNull(), F.col("error"))
    if bot:
        out = out.when(r.is_bot_challenge(*seen), "bot_challenge")
    if denied:
        out = out.when(r.is_access_denied(*seen), "access_denied")
    for name, test in (("bot_challenge", more_bot), ("access_denied", more_denied)):
        if test is not None:
            out = out.when(F.coalesce(test(*seen), F.lit(False)), name)
    return out


class CompositeFetcher:
    """Tries fetchers in order; a request goes to the next one only if the ones before failed or were refused.

    ``fetch`` gives one row a request: the first accepted response, else an error that names the last failure.
    ``attempts`` gives every rejected try (the error log); ``fetch_logged`` gives both from the same tries. Each tier's answers are
    written to the shared folder before they are judged, so a tier gets a request once, whatever is read afterwards.
    """

    name = "composite"

    def __init__(self, fetchers: list, detect_bot_challenge=True, detect_access_denied=True, on_bot=None, on_denied=None):
        self.fetchers = list(fetchers)
        self.reason = refusal(detect_bot_challenge, detect_access_denied, on_bot, on_denied)

    def __len__(self):
        return len(self.fetchers)

    def _tries(self, requests: DataFrame):
        todo, tries = requests, []
        for k, f in enumerate(self.fetchers):
            tried = written(f.fetch(todo).withColumn("priority", F.lit(k)).withColumn("refused", self.reason), f"tier{k}")
            tries.append(tried)
            todo = tried.where("refused is not null").select(*requests.columns)
        return tries

    def fetch(self, requests: DataFrame) -> DataFrame:
        return self.fetch_logged(requests)[0]

    def attempts(self, requests: DataFrame) -> DataFrame:
        return self.fetch_logged(requests)[1]

    def fetch_logged(self, requests: DataFrame, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
        """(responses, rejected tries: keys, url, fetcher, priority, refused) of one round of sending."""
        nothing = F.lit(None)
        if not self.fetchers:
            out = requests.where(~F.col("aborted")).select(
                "*", nothing.cast("int").alias("status"), nothing.cast("map<string,string>").alias("response_headers"),
                nothing.cast("string").alias("response_body"), nothing.cast("string").alias("final_url"),
                nothing.cast("string").alias("fetcher"), F.lit("no fetcher configured").alias("error"),
            )
            return out, out.select(*keys, "url", "fetcher", nothing.cast("int").alias("priority"), F.col("error").alias("refused")).limit(0)
        out = log = None
        tries = self._tries(requests)
        for k, t in enumerate(tries):
            last = k == len(tries) - 1
            kept = t if last else t.where("refused is null")
            if last:
                failed = F.col("refused").isNotNull()
                kept = kept.withColumn("error", F.when(failed, F.concat(F.lit("all fetchers failed: "), F.col("refused"))))
                for c in ("status", "response_headers", "response_body", "final_url", "fetcher"):
                    kept = kept.withColumn(c, F.when(~failed, F.col(c)))
            kept = kept.drop("priority", "refused")
            rejected = t.where("refused is not null").select(*keys, "url", "fetcher", "priority", "refused")
            out = kept if out is None else out.unionByName(kept)
            log = rejected if log is None else log.unionByName(rejected)
        return out, log


def failover(candidates: DataFrame, key: str = "url", priority: str = "priority", reason: Column | None = None) -> DataFrame:
    """Over responses that are all there already: per key the accepted one of least priority, by one aggregate."""
    judged = candidates.withColumn("_why", reason if reason is not None else refusal())
    row = F.struct(*(c for c in candidates.columns if c != key))
    best = judged.groupBy(key).agg(
        F.min_by(F.when(F.col("_why").isNull(), row), F.when(F.col("_why").isNull(), F.col(priority))).alias("r"),
        F.max_by("_why", priority).alias("_last"),
    )
    return best.select(key, "r.*", F.when(F.col("r").isNull(), F.concat(F.lit("all fetchers failed: "), F.col("_last"))).alias("failure"))


def page_reader(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages in any format Spark reads, by the path's ending (parquet by default)."""
    kind = next((k for k in ("json", "csv", "orc") if path.rstrip("/").endswith("." + k)), "parquet")
    return spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {})).load(path)
