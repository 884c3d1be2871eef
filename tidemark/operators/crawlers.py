"""Crawler removal by request rate, and the clean log it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import seconds_between
from tidemark.functions.urls import request_url

VISITOR = ["month", "ip"]
DEFAULT_RATE = 30


def minute_counts(log: DataFrame) -> DataFrame:
    """Requests per visitor and minute. The counts combine before the shuffle, so a busy address is cheap."""
    return log.groupBy(*VISITOR, F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("log_type") == "http").alias("has_http"),
    )


def visitor_peaks(log: DataFrame) -> DataFrame:
    """Busiest minute of every visitor, its number of requests and whether it made page requests."""
    return minute_counts(log).groupBy(*VISITOR).agg(
        F.max("n").alias("peak"), F.sum("n").alias("requests"), F.bool_or("has_http").alias("has_http")
    )


def dropped_visitors(log: DataFrame, rate: int = DEFAULT_RATE, http_only: bool = True) -> DataFrame:
    """Visitors at or over the rate in some minute; with ``http_only`` also those without page requests."""
    bad = F.col("peak") >= rate
    if http_only:
        bad = bad | ~F.col("has_http")
    return visitor_peaks(log).where(bad).select(*VISITOR)


def without_crawlers(log: DataFrame, rate: int = DEFAULT_RATE, http_only: bool = True) -> DataFrame:
    """Rows of the remaining visitors.

    The anti join leaves its strategy to the runtime statistics: the dropped list is broadcast when it
    turns out small, and a hot address on the log side is split by the adaptive skew join otherwise.
    """
    return log.join(dropped_visitors(log, rate, http_only), VISITOR, "left_anti")


def with_to_last(log: DataFrame) -> DataFrame:
    """Seconds since the visitor's previous request, 0 for the first.

    After crawler removal a visitor-month holds fewer than rate x 44,640 rows, which bounds the window.
    """
    w = Window.partitionBy(*VISITOR).orderBy("ts", "line_id")
    gap = F.abs(seconds_between(F.lag("ts").over(w), F.col("ts")))
    return log.withColumn("to_last", F.coalesce(gap, F.lit(0)).cast("int"))


def remove_crawlers(
    log: DataFrame, site: str, rate: int = DEFAULT_RATE, http_only: bool = True
) -> DataFrame:
    """Clean log: rate-based crawlers gone, request URL and time to the previous request added."""
    kept = without_crawlers(log, rate, http_only)
    located = kept.withColumn("request_url", request_url(F.col("log_type"), F.col("request"), site))
    return with_to_last(located)
