"""Sessions: by referer, by silence, merging of short ones, and session statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import seconds_between, session_url
from tidemark.functions.text import normalise_list
from tidemark.functions.urls import download_path, request_path, search_info, viewed_dataset
from tidemark.operators.crawlers import VISITOR

DEFAULT_GAP = 600
SESSION = [*VISITOR, "session_id"]
INVALID = "invalid"


# --- sessions by referer ---------------------------------------------------------------------------


class TailSums:
    """A growing row of numbers with the sum of any tail, both in logarithmic time (a Fenwick tree)."""

    def __init__(self):
        self.total = 0
        self.tree = [0]

    def append(self, value: int) -> None:
        place, step, node = len(self.tree), 1, value
        while step < place & -place:
            node += self.tree[place - step]
            step *= 2
        self.tree.append(node)
        self.total += value

    def add(self, position: int, value: int) -> None:
        place = position + 1
        while place < len(self.tree):
            self.tree[place] += value
            place += place & -place
        self.total += value

    def tail(self, position: int) -> int:
        before = 0
        while position:
            before += self.tree[position]
            position -= position & -position
        return self.total - before


class VisitorSessions:
    """Running state of one visitor: per session the time of each URL and the order of access."""

    def __init__(self, gap: int):
        self.gap = gap
        self.started = 0
        self.has_zero = False
        self.urls: list[dict[str, tuple[int, int]]] = [{}]
        self.latest: list[TailSums] = [TailSums()]
        self.sizes = TailSums()
        self.sizes.append(0)
        self.last_time: list[int] = [0]
        self.newest_with: dict[str, int] = {}

    def record(self, session: int, url: str, time: int) -> int:
        known, marks = self.urls[session], self.latest[session]
        if url in known:
            marks.add(known[url][0], -1)
        else:
            self.sizes.add(session, 1)
        known[url] = (len(marks.tree) - 1, time)
        marks.append(1)
        self.last_time[session] = time
        if self.newest_with.get(url, -1) < session:
            self.newest_with[url] = session
        if session == 0:
            self.has_zero = True
        return session

    def open(self, url: str, time: int) -> int:
        self.started += 1
        self.urls.append({})
        self.latest.append(TailSums())
        self.sizes.append(0)
        self.last_time.append(time)
        return self.record(self.started, url, time)

    def page(self, url: str, referer: str | None, in_site: bool, time: int) -> int:
        if not in_site:
            return self.open(url, time)
        session = self.newest_with.get(referer)
        if session is None:
            return self.open(url, time) if self.has_zero else self.record(0, url, time)
        position, seen = self.urls[session][referer]
        walked = self.sizes.tail(session + 1) + self.latest[session].tail(position)
        if abs(time - seen) < self.gap * walked:
            return self.record(session, url, time)
        return self.open(url, time)

    def transfer(self, url: str, time: int) -> int:
        current = self.started
        if current == 0 and not self.has_zero:
            return self.record(0, url, time)
        if abs(time - self.last_time[current]) > self.gap:
            return self.open(url, time)
        return self.record(current, url, time)


def _assign_sessions(gap: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor, state = None, None
        for batch in batches:
            read = [batch.column(c).to_pylist() for c in
                    ("month", "ip", "log_type", "request_url", "_referer", "_in_site", "_time")]
            ids = []
            for month, ip, log_type, url, referer, in_site, time in zip(*read):
                if (month, ip) != visitor:
                    visitor, state = (month, ip), VisitorSessions(gap)
                if log_type == "ftp":
                    number = state.transfer(url, time)
                else:
                    number = state.page(url, referer, in_site, time)
                ids.append(f"{ip}@{number}")
            kept = [n for n in batch.schema.names if not n.startswith("_")]
            columns = [batch.column(n) for n in kept] + [pa.array(ids, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "session_id"])

    return run


def sessions_by_referer(log: DataFrame, site: str, gap: int = DEFAULT_GAP) -> DataFrame:
    """Add ``session_id`` (``ip@n``) to a clean log by following referers.

    Page requests without an in-site referer open a session. Others look for the referer from the newest
    session back, most recent page first, and join when the page is less than ``gap`` seconds times the
    pages walked old. Transfers continue the newest session unless it has been silent longer than ``gap``.

    The rule depends on every earlier decision for the visitor, so visitors are laid out contiguously
    and in time order and each task streams over its rows. Nothing is collected: the state is one
    visitor's pages, and crawler removal bounds a visitor-month to under rate x 44,640 rows.
    """
    home = F.lit(site + "/")
    inside = F.contains(F.col("referer"), home) & (F.col("referer") != home)
    ordered = (
        log.withColumn("_referer", F.lower("referer"))
        .withColumn("_in_site", F.coalesce(inside, F.lit(False)))
        .withColumn("_time", F.unix_seconds("ts"))
        .repartition(*VISITOR)
        .sortWithinPartitions(*VISITOR, "ts", "line_id")
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields)
    return ordered.mapInArrow(_assign_sessions(gap), f"{fields}, session_id string")


# --- sessions by silence ---------------------------------------------------------------------------


def sessions_by_gap(
    log: DataFrame, gap: int = DEFAULT_GAP, keys: Sequence[str] = VISITOR
) -> DataFrame:
    """Add ``session_id``: a visitor's requests split wherever more than ``gap`` seconds pass.

    Built for any log, cleaned or not: the big shuffle and its sort are by visitor and day, so a visitor
    with a third of all rows spreads over its days. Days meet in a table of one row per visitor and day.
    """
    keys = list(keys)
    day = [*keys, "_day"]
    rows = log.withColumn("_day", F.to_date("ts")).repartition(*day)
    in_day = Window.partitionBy(*day).orderBy("ts", "line_id")
    silent = seconds_between(F.lag("ts").over(in_day), F.col("ts")) > gap
    marked = rows.withColumn("_new", F.coalesce(silent, F.lit(False)).cast("int")).withColumn(
        "_local", F.sum("_new").over(in_day.rowsBetween(Window.unboundedPreceding, 0))
    )
    days = marked.groupBy(*day).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("_new").alias("inner")
    )
    across = Window.partitionBy(*keys).orderBy("_day")
    opens = seconds_between(F.lag("last").over(across), F.col("first")) > gap
    numbered = days.withColumn("opens", F.coalesce(opens, F.lit(True)).cast("int")).withColumn(
        "_base",
        F.sum(F.col("opens") + F.col("inner")).over(across.rowsBetween(Window.unboundedPreceding, 0))
        - F.col("inner"),
    )
    joined = marked.join(numbered.select(*day, "_base"), day)
    number = (F.col("_base") + F.col("_local")).cast("string")
    return joined.withColumn("session_id", F.concat("ip", F.lit("@"), number)).select(
        *log.columns, "session_id"
    )


# --- merging short sessions ------------------------------------------------------------------------


def visitor_referers(log: DataFrame) -> DataFrame:
    """Requests and share of requests without a referer, per visitor."""
    return log.groupBy(*VISITOR).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("referer") == "-").alias("no_referer"),
    ).withColumn("no_referer_ratio", F.col("no_referer") / F.col("requests"))


def combine_short_sessions(
    log: DataFrame, gap: int = DEFAULT_GAP, max_ratio: float = 0.8, min_requests: int = 3,
    compat: bool = False,
) -> DataFrame:
    """Mark visitors without real sessions ``invalid`` and merge sessions that end close together.

    A visitor is invalid with fewer than ``min_requests`` rows or when the share of rows without a
    referer reaches ``max_ratio`` (``compat`` means all of them). Sessions are ordered by end; one that
    ends less than ``gap`` seconds after the one before takes the id of the first of its chain.
    Rows are added up to one per session first; windows and the join back see sessions only.
    """
    ends = log.groupBy(*SESSION).agg(
        F.max("ts").alias("_end"),
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("referer") == "-").alias("_bare"),
    )
    whole = Window.partitionBy(*VISITOR)
    by_end = whole.orderBy("_end", "session_id")
    requests, missing = F.sum("_rows").over(whole), F.sum("_bare").over(whole)
    dropped = (missing == requests) if compat else (missing / requests >= max_ratio)
    flagged = ends.withColumn("_invalid", dropped | (requests < min_requests)).withColumn(
        "_last", F.lag("_end").over(by_end)
    )
    starts = F.col("_last").isNull() | (seconds_between(F.col("_last"), F.col("_end")) >= gap)
    chained = flagged.withColumn(
        "_merged",
        F.last(F.when(starts, F.col("session_id")), ignorenulls=True).over(
            by_end.rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    merged = F.when(F.col("_invalid"), INVALID).otherwise(F.col("_merged"))
    names = chained.select(*SESSION, merged.alias("_name"))
    others = [c for c in log.columns if c != "session_id"]
    return log.join(names, SESSION).select(*others, F.col("_name").alias("session_id")).select(*log.columns)


# --- session statistics ----------------------------------------------------------------------------


class Gate(NamedTuple):
    """What a good session holds. The defaults."""

    min_requests: int = 3
    max_lists: int = 100
    max_views: int = 200
    max_downloads: int = 100



def _page(log_type: Column, request: Column) -> Column:
    return F.coalesce(F.when(log_type == "http", request_path(request)), request)


def _ordered_distinct(value: Column) -> Column:
    """Distinct values of a group in time order; nulls and '' are left out."""
    seen = F.collect_list(F.when(value != "", F.struct("ts", "line_id", value.alias("v"))))
    return F.array_distinct(F.transform(F.array_sort(seen), lambda x: x["v"]))


def session_statistics(
    log: DataFrame, session_type: str = "sessionstats", request_type: str = "cleanup", gate: Gate = Gate()
) -> DataFrame:
    """One row per good session: span, counters, keywords, views and downloads in order of first use.

    The gate is applied to plain counters first, so lists are gathered only for sessions that pass.
    """
    page = _page(F.col("log_type"), F.col("request"))
    rows = log.where(F.col("session_id") != INVALID).withColumn("_page", page)
    is_list = F.contains("_page", F.lit("/datasetlist?"))
    is_view = F.startswith("_page", F.lit("/dataset/"))
    gated = with_session_gate(rows, is_list, is_view, gate)
    detailed = (
        gated.withColumn("_keywords", F.when(is_list, search_info(F.col("_page"))))
        .withColumn("_view", viewed_dataset(F.col("_page")))
        .withColumn("_download", download_path(F.col("log_type"), F.col("request")))
    )
    listed = F.collect_list(F.when(F.size("_keywords") > 0, F.struct("ts", "line_id", F.col("_keywords").alias("v"))))
    words = F.array_distinct(F.flatten(F.transform(F.array_sort(listed), lambda x: x["v"])))
    stats = detailed.groupBy(*SESSION).agg(
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(is_list).alias("list_count"),
        F.count_if(F.size("_keywords") > 0).alias("keyword_list_count"),
        F.count_if(is_view).alias("view_count"),
        F.count_if(F.col("log_type") == "ftp").alias("download_count"),
        words.alias("raw_keywords"),
        _ordered_distinct(F.col("_view")).alias("views"),
        _ordered_distinct(F.col("_download")).alias("downloads"),
    )
    duration = seconds_between(F.col("start"), F.col("end"))
    return stats.select(
        *SESSION,
        session_url(F.col("session_id"), session_type, request_type).alias("session_url"),
        "start", "end", duration.alias("duration"), "request_count", "list_count",
        "keyword_list_count", "view_count", "download_count",
        (F.col("request_count") / F.nullif(duration, F.lit(0))).alias("request_rate"),
        normalise_list(F.col("raw_keywords")).alias("keywords"),
        F.size("raw_keywords").alias("keyword_count"),
        "views", "downloads",
    )


def with_session_gate(rows: DataFrame, is_list: Column, is_view: Column, gate: Gate = Gate()) -> DataFrame:
    """Rows of sessions with enough requests and a plausible number of searches, views and downloads."""
    w = Window.partitionBy(*SESSION)
    return (
        rows.withColumn("_n", F.count(F.lit(1)).over(w))
        .withColumn("_lists", F.count_if(is_list).over(w))
        .withColumn("_views", F.count_if(is_view).over(w))
        .withColumn("_transfers", F.count_if(F.col("log_type") == "ftp").over(w))
        .where(
            (F.col("_n") >= gate.min_requests)
            & F.col("_lists").between(1, gate.max_lists)
            & F.col("_views").between(1, gate.max_views)
            & (F.col("_transfers") <= gate.max_downloads)
        )
        .drop("_n", "_lists", "_views", "_transfers")
    )


def valid_session_rows(log: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """Log rows that belong to a session which passes the gate (no join: the counters are windows)."""
    page = _page(F.col("log_type"), F.col("request"))
    rows = log.where(F.col("session_id") != INVALID).withColumn("_page", page)
    return with_session_gate(
        rows, F.contains("_page", F.lit("/datasetlist?")), F.startswith("_page", F.lit("/dataset/")), gate
    ).drop("_page")


def session_requests(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Requests numbered in time order inside each session; a ``limit`` keeps the first ones only."""
    w = Window.partitionBy(*SESSION).orderBy("ts", "line_id")
    numbered = log.withColumn("seq", F.row_number().over(w))
    return numbered if limit is None else numbered.where(F.col("seq") <= limit)
