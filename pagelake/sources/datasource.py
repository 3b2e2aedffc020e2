"""A Spark data source over HTTP: spark.read.format("http_pages").option("urls", ...).load()."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.config import FetchConfig
from .fetch import http_get


class UrlPartition(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        urls = options.get("urls", "[]")
        self.urls = json.loads(urls) if urls.lstrip().startswith("[") else urls.split()
        self.parts = max(1, int(options.get("partitions", "8")))
        self.config = FetchConfig(timeout_secs=float(options.get("timeout", "30")), max_retries=int(options.get("retries", "3")))
        self.agent = options.get("useragent", "pagelake")

    def partitions(self) -> list[InputPartition]:
        return [UrlPartition(self.urls[k :: self.parts]) for k in range(min(self.parts, max(1, len(self.urls))))]

    def read(self, partition: UrlPartition) -> Iterator[tuple]:
        get = http_get(self.config)
        for url in partition.urls:
            row = (url, None, None, None, None)
            for _ in range(self.config.max_retries + 1):
                try:
                    status, _, html, final = get(url, "GET", {"User-Agent": self.agent}, None)
                    row = (url, status, html, final, None)
                    break
                except Exception as e:
                    row = (url, None, None, None, f"http: {e}")
            yield row


class HttpPages(DataSource):
    """Options: urls (JSON array, or separated by spaces), partitions, timeout, retries, useragent."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "url string, status int, html string, final_url string, error string"

    def reader(self, schema) -> HttpReader:
        return HttpReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpPages)
