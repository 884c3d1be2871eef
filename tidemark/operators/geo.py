"""Visitor addresses to locations through a table of address ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 address as a number; null when malformed."""
    part = lambda i: F.get(F.split(ip, "[.]"), F.lit(i)).try_cast("bigint")
    return part(0) * (1 << 24) + part(1) * (1 << 16) + part(2) * (1 << 8) + part(3)


def locate(visitors: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ip, location) of distinct addresses; null outside every range. Ranges (lo, hi, location) are disjoint.

    Ranges are cut at 65,536-address blocks and meet the addresses in one sorted pass per block: the
    range that started last is the only one that can hold an address. No address meets all ranges.
    """
    numbered = visitors.select("ip").distinct().withColumn("at", ip_number(F.col("ip")))
    cut = ranges.select(
        "lo", "hi", "location",
        F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))).alias("block"),
    ).select(
        "block", F.greatest("lo", F.col("block") * BLOCK).alias("at"), "hi", "location",
        F.lit(None).cast("string").alias("ip"), F.lit(0).alias("kind"),
    )
    asked = numbered.where("at is not null").select(
        F.floor(F.col("at") / BLOCK).alias("block"), "at", F.lit(None).cast("bigint").alias("hi"),
        F.lit(None).cast("string").alias("location"), "ip", F.lit(1).alias("kind"),
    )
    w = Window.partitionBy("block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("kind") == 0, F.struct("hi", "location")), ignorenulls=True).over(w)
    placed = cut.unionByName(asked).withColumn("_range", start).where(F.col("kind") == 1)
    inside = F.col("at") <= F.col("_range.hi")
    bad = numbered.where("at is null").select("ip", F.lit(None).cast("string").alias("location"))
    return placed.select("ip", F.when(inside, F.col("_range.location")).alias("location")).unionByName(bad)
