"""Media downloads: bytes by a transport in the workers, everything else native."""

from __future__ import annotations

import base64
import hashlib
import time
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import media_type
from ..functions.urls import filename
from ..plans.config import DownloadConfig
from .parallel import in_threads


def http_download(config: DownloadConfig = DownloadConfig()) -> Callable:
    """A transport over the standard library, with the configuration's timeout and user agent; it reads no more than tells that a file is too large."""

    def get(url):
        import urllib.error
        import urllib.request

        request = urllib.request.Request(url, headers={"user-agent": config.user_agent})
        try:
            answer = urllib.request.urlopen(request, timeout=config.timeout_secs)
        except urllib.error.HTTPError as e:
            answer = e
        with answer:
            declared = answer.headers.get("content-length")
            data = answer.read() if config.max_file_size is None else answer.read(config.max_file_size + 1)
            return answer.status, answer.headers.get("content-type"), int(declared) if declared else None, data

    return get


class MediaDownloader:
    """``get(url) -> (status, content_type, declared length or None, bytes)`` is called for every URL, with retries, ``max_concurrent`` at once in a task."""

    def __init__(self, get: Callable | None = None, config: DownloadConfig = DownloadConfig()):
        self.get, self.config = get or http_download(config), config

    def _call(self) -> Callable:
        get, c = self.get, self.config

        def call(u):
            error = None
            for k in range(c.max_retries + 1):
                if k:
                    time.sleep(c.retry_delay_ms / 1000 * 2 ** (k - 1))
                try:
                    status, kind, declared, data = get(u)
                except Exception as e:
                    error = f"network: {e}"
                    continue
                if not 200 <= status < 300:
                    error = f"http: {status}"
                    continue
                return kind, declared, bytes(data), None
            return None, None, None, error

        return call

    def download(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """url, bytes, content_type, size, hash, media_type, base64, error: a row per input row, in no order.

        Statuses other than 2xx and files above the limit, declared or actual, are errors without bytes.
        """
        c = self.config
        wanted = urls.select(F.col(url).cast("string").alias("url"))
        got = in_threads(wanted, self._call(), ["url"], "content_type string, declared long, bytes binary, error string", c.max_concurrent)
        size = F.coalesce("declared", F.octet_length("bytes").cast("long"))
        big = F.lit(False)
        if c.max_file_size is not None:
            big = F.coalesce(F.greatest("declared", F.octet_length("bytes").cast("long")) > c.max_file_size, F.lit(False))
        data = F.when(~big, F.col("bytes"))
        return got.select(
            "url", data.alias("bytes"), "content_type", F.when(F.col("error").isNull(), size).alias("size"),
            F.sha2(data, 256).alias("hash"), F.when(data.isNotNull(), media_type(F.col("content_type"), F.col("url"))).alias("media_type"),
            (F.base64(data) if c.encode_base64 else F.lit(None).cast("string")).alias("base64"),
            F.when(big, F.concat(F.lit("file too large: "), size.cast("string"))).otherwise(F.col("error")).alias("error"),
        )

    def download_to_dir(self, urls: DataFrame, folder: str, url: str = "url") -> DataFrame:
        """url and path of each file written below ``folder`` by the workers, error otherwise; ``folder`` must be one that all executors share."""

        def save(name, data):
            return (None if data is None else save_to_file(data, folder, name),)

        got = self.download(urls, url).withColumn("_name", filename(F.col("url"))).select("url", "_name", "bytes", "error")
        return in_threads(got, save, ["_name", "bytes"], "path string", self.config.max_concurrent).select("url", "path", "error")

    def one(self, url: str) -> bytes:
        """The bytes of one URL, on the driver; a failure is an OSError."""
        _, declared, data, error = self._call()(url)
        most = self.config.max_file_size
        if error is None and most is not None and max(declared or 0, len(data)) > most:
            error = f"file too large: {declared or len(data)}"
        if error is not None:
            raise OSError(error)
        return data


def download_bytes(url: str, get: Callable | None = None) -> bytes:
    return MediaDownloader(get).one(url)


def download_with_hash(url: str, get: Callable | None = None) -> tuple[bytes, str]:
    """The bytes and their SHA-256."""
    data = download_bytes(url, get)
    return data, hashlib.sha256(data).hexdigest()


def download_to_base64(url: str, get: Callable | None = None) -> str:
    return base64.b64encode(download_bytes(url, get)).decode()


def save_to_file(data: bytes, folder: str, name: str) -> str:
    """Writes beside the target and renames, so that no half file stays under its name; returns the path."""
    import os

    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    part = f"{path}.{os.getpid()}.{time.monotonic_ns()}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)
    return path
