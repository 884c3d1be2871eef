"""Keyword sets of sessions from vertical lists.

The list of a set is the sessions that hold it, as rows (items before the last, last item, session). Two sets
that differ in their last item only are joined on the rest and the session: a row of the result is a session
that holds the larger set, so sets that no session holds are never looked at. After each level sets under the
support go, and with them everything that would hold them. No list and no long session is ever gathered in a row.

Where sets are only counted, a session with few of them is one row, its sets are spelt out there and counted before any
shuffle; the lists are those of long sessions, and what is rare in all sessions leaves them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

BLOCK = 1024  # items of a session that are met with as many others in one key
ROW_SETS = 4096  # sets of a session that are spelt out from one row


def _items(keywords: DataFrame, support: int) -> DataFrame:
    """(session_id, item) of the distinct keywords with the support."""
    items = keywords.select("session_id", F.col("keyword").alias("item")).where("session_id IS NOT NULL AND item IS NOT NULL").distinct()
    if support <= 1:
        return items
    frequent = items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    return items.join(frequent.select("item"), "item", "left_semi").select("session_id", "item")


def _pairs(items: DataFrame) -> DataFrame:
    """(head, last, session_id) of the pairs of each session, head an array of one. Long sessions are met in blocks."""
    sizes = items.groupBy("session_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = items.join(sizes, "session_id").withColumn("block", F.pmod(F.xxhash64("item"), "blocks"))
    left = placed.select("session_id", F.col("item").alias("first"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    right = placed.select("session_id", "block", F.col("item").alias("last"))
    met = left.join(right, ["session_id", "block"]).where(F.col("first") < F.col("last"))
    return met.select(F.array("first").alias("head"), "last", "session_id")


def _singles(items: DataFrame) -> DataFrame:
    return items.select(F.array().cast("array<string>").alias("head"), F.col("item").alias("last"), "session_id")


def _longer(lists: DataFrame) -> DataFrame:
    """The lists of the sets with one item more."""
    right = lists.select("head", "session_id", F.col("last").alias("other"))
    return lists.join(right, ["head", "session_id"]).where(F.col("last") < F.col("other")).select(
        F.array_append("head", F.col("last")).alias("head"), F.col("other").alias("last"), "session_id"
    )


def vertical_lists(keywords: DataFrame, size: int, support: int = 1) -> DataFrame:
    """(head, last, session_id): the sessions of every set of `size` keywords that `support` sessions hold.

    head is the array of all items but the last; items ascend. `keywords` is (session_id, keyword); repeated rows
    count once, nulls are left out.
    """
    if size < 1 or support < 1:
        raise ValueError("size and support start at 1")
    items = stage(_items(keywords, support), "frequent-items")
    lists = _singles(items)
    for level in range(2, size + 1):
        lists = _pairs(items) if level == 2 else _longer(lists)
        if support > 1:
            lists = stage(lists, f"sets-of-{level}")
            frequent = lists.groupBy("head", "last").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
            lists = lists.join(frequent.select("head", "last"), ["head", "last"], "left_semi")
            if level < size:
                lists = stage(lists, f"lists-of-{level}")
    return lists


def keyword_combinations(keywords: DataFrame, size: int) -> DataFrame:
    """(session_id, itemset): all combinations of `size` keywords of each session, ascending and comma-joined."""
    lists = vertical_lists(keywords, size)
    return lists.select("session_id", F.concat_ws(",", "head", "last").alias("itemset"))


def row_items(size: int) -> int:
    """The most items of a session whose sets of up to `size` items are spelt out from one row."""
    return next(n for n in range(1, BLOCK + 1) if n == BLOCK or max(math.comb(n + 1, k) for k in range(1, size + 1)) > ROW_SETS)


def _spelt(sessions: DataFrame, size: int) -> DataFrame:
    """(head, last) of every set of `size` items of each session, rows with a sorted array `items`."""
    rows = sessions.select("items", F.lit(0).alias("at"), F.array().cast("array<string>").alias("head"))
    for level in range(1, size + 1):
        later = F.posexplode(F.slice("items", F.col("at") + 1, F.size("items"))).alias("skipped", "last")
        rows = rows.select("items", "at", "head", later)
        if level < size:
            rows = rows.select("items", (F.col("at") + F.col("skipped") + 1).alias("at"), F.array_append("head", F.col("last")).alias("head"))
    return rows.select("head", "last")


def frequent_sets(keywords: DataFrame, size: int, support: int) -> DataFrame:
    """(items, sessions): the sets of `size` keywords that at least `support` sessions hold, and how many do.

    `keywords` is (session_id, keyword); repeated rows count once, nulls are left out.
    """
    if size < 1 or support < 1:
        raise ValueError("size and support start at 1")
    items = stage(_items(keywords, support), "frequent-items")
    lengths = items.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    long = stage(lengths.where(F.col("n") > row_items(size)).select("session_id"), "long-sessions")
    rows = items.join(long, "session_id", "left_anti").groupBy("session_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    rows = stage(rows.select("items"), "session-items")
    held = stage(items.join(long, "session_id", "left_semi"), "long-session-items")
    lists = None if long.isEmpty() else _singles(held)
    for level in range(1 if lists is not None else size, size + 1):
        counts = [_spelt(rows, level).groupBy("head", "last").agg(F.count(F.lit(1)).alias("sessions"))]
        if lists is not None:
            if level > 1:
                lists = stage(_pairs(held) if level == 2 else _longer(lists), f"sets-of-{level}")
            counts.append(lists.groupBy("head", "last").agg(F.count(F.lit(1)).alias("sessions")))
        counted = reduce(DataFrame.unionByName, counts).groupBy("head", "last").agg(F.sum("sessions").alias("sessions"))
        counted = counted.where(F.col("sessions") >= support)
        if level < size:
            lists = stage(lists.join(counted.select("head", "last"), ["head", "last"], "left_semi"), f"lists-of-{level}")
    return counted.select(F.array_append("head", F.col("last")).alias("items"), "sessions")
