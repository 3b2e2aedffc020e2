"""Incremental variants: pages arriving as files, visited URLs as streaming state, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_host


def page_stream(spark: SparkSession, folder: str, schema: str = "page_id long, url string, html string", per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def first_visits(pages: DataFrame, url: str = "url", time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each URL once; with an event-time column, state older than the watermark is dropped."""
    if time is None:
        return pages.dropDuplicates([url])
    return pages.withWatermark(time, delay).dropDuplicatesWithinWatermark([url])


def host_rates(pages: DataFrame, url: str, time: str, window: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """Pages per host and event-time window; late rows beyond the watermark are left out."""
    return pages.withWatermark(time, delay).groupBy(F.window(time, window).alias("window"), url_host(F.col(url)).alias("host")).agg(
        F.count("*").alias("pages")
    )


def event_counts(events: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events by type and hour, with their summed value."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )


def polite(requests: DataFrame, url: str = "url", seq: str = "seq", delay_s: float = 1.0) -> DataFrame:
    """Start second of each request of a stream, keeping per host the second at which it is free again."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def plan(key, batches, state: GroupState):
        free = state.get[0] if state.exists else 0.0
        for b in batches:
            b = b.sort_values([seq, url])
            yield pd.DataFrame({"host": key[0], "url": b[url], "start_s": [free + k * delay_s for k in range(len(b))]})
            free += len(b) * delay_s
        state.update((free,))

    return (
        requests.withColumn("host", url_host(F.col(url))).groupBy("host")
        .applyInPandasWithState(plan, "host string, url string, start_s double", "free double", "append", GroupStateTimeout.NoTimeout)
    )
