"""Shards from a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import xxhash
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import stage

NODES = 64  # virtual nodes of a shard
SUBS = 32  # runs of positions in an arc that are ranked apart


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(position, shard) of the virtual nodes, ascending; positions are signed 64-bit hashes of their names."""
    points = []
    for shard in range(shards):
        for node in range(nodes):
            h = xxhash.xxh64_intdigest(f"shard-{shard}-{node}", 42)
            points.append((h - (1 << 64) if h >> 63 else h, shard))
    return sorted(points)


def flow(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """Who takes which ranks of which arc: (arc, first rank, ranks, shard), from the number of keys on each arc.

    Keys wait at the virtual node that ends their arc. In each round every shard takes what its free
    capacity allows, arc by arc and rank by rank; the rest goes on clockwise to the next virtual node.
    Capacity is at least the number of keys, so it ends after a turn of the ring at most.
    """
    free = list(capacity)
    waiting = [[(arc, 0, n)] if n else [] for arc, n in enumerate(counts)]
    taken = []
    while any(waiting):
        moved: list[list[tuple[int, int, int]]] = [[] for _ in counts]
        for node, runs in enumerate(waiting):
            shard = owners[node]
            for arc, first, n in runs:
                take = min(n, free[shard])
                if take:
                    taken.append((arc, first, take, shard))
                    free[shard] -= take
                if n > take:
                    moved[(node + 1) % len(counts)].append((arc, first + take, n - take))
        waiting = moved
    return taken


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Rows each shard may hold: (1 + slack) times the mean; without slack the first ones get the odd rows."""
    if slack > 0:
        return [int((1 + slack) * rows / shards) + 1] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def bounded_ring_shards(keys: DataFrame, columns: list[str], shards: int, slack: float = 0.0, nodes: int = NODES) -> DataFrame:
    """`keys` with shard and slot, one row per row of `keys`.

    A row's place on the ring is a hash of `columns[0]`; ties are ordered by the other columns. What the
    driver holds is a count for each of shards x nodes arcs, which doesn't grow with the data. Equal rows
    are counted before the shuffle and told apart at the end only, so a key may repeat without limit; an
    arc is ranked in `SUBS` runs of positions, so no window holds more than a small share of the rows.

    slack = 0 makes the counts of any two shards differ by one at most. slot numbers a shard's rows from 0
    without gaps. Nulls are values. No rows in, no rows out.
    """
    spark: SparkSession = keys.sparkSession
    points = ring(shards, nodes)
    positions = [p for p, _ in points]
    owners = [s for _, s in points]
    bounds = F.lit(positions)
    # The arc of a position is the first virtual node at or after it; past the last one, the first.
    place = F.xxhash64(F.coalesce(F.col(columns[0]).cast("string"), F.lit("\u0000")))
    kinds = keys.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_place", place)
    below = F.aggregate(
        F.sequence(F.lit(0), F.lit(len(positions).bit_length())),
        F.struct(F.lit(0).alias("lo"), F.lit(len(positions)).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
            F.when(
                F.get(bounds, F.floor((s["lo"] + s["hi"]) / 2).cast("int")) < F.col("_place"),
                F.struct((F.floor((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi")),
            ).otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))
        ),
    )["lo"]
    kinds = stage(
        kinds.withColumn("_arc", F.pmod(below, F.lit(len(positions))).cast("int"))
        .withColumn("_sub", F.floor((F.col("_place") / 2.0**64 + 0.5) * (1 << 20)).cast("int")),
        "ring-keys",
    )
    # Runs of an arc: its positions in order, cut at fixed steps of the ring.
    step = max(1, (1 << 20) // (len(positions) * SUBS))
    kinds = kinds.withColumn("_sub", F.floor(F.col("_sub") / step).cast("int"))
    runs = kinds.groupBy("_arc", "_sub").agg(F.sum("_n").alias("_rows"))
    # The last arc runs over the end of the ring: the positions after the last node come first in it.
    wrapped = F.when((F.col("_arc") == 0) & (F.col("_sub") > (1 << 19) // step), 0).otherwise(1)
    before = Window.partitionBy("_arc").orderBy(wrapped, "_sub").rowsBetween(Window.unboundedPreceding, -1)
    runs = stage(runs.withColumn("_first", F.coalesce(F.sum("_rows").over(before), F.lit(0))), "ring-runs")
    counts = [0] * len(positions)
    for arc, n in runs.groupBy("_arc").agg(F.sum("_rows")).collect():
        counts[arc] = n
    taken = flow(counts, owners, capacities(sum(counts), shards, slack))
    held = [0] * shards
    spans = []
    for arc, first, n, shard in sorted(taken):
        spans.append((arc, first, first + n, shard, held[shard]))
        held[shard] += n
    spans = spark.createDataFrame(spans, "_arc int, _from bigint, _to bigint, shard int, _base bigint")
    inside = Window.partitionBy("_arc", "_sub").orderBy("_place", *columns)
    ranked = (
        kinds.withColumn("_upto", F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(runs.select("_arc", "_sub", "_first"), ["_arc", "_sub"])
        .withColumn("_lo", F.col("_first") + F.col("_upto") - F.col("_n"))
        .withColumn("_hi", F.col("_first") + F.col("_upto"))
    )
    # Spans are at most the arcs and one cut for each round and shard.
    met = ranked.join(F.broadcast(spans), "_arc").where("_lo < _to and _hi > _from")
    begin, end = F.greatest("_lo", "_from"), F.least("_hi", "_to")
    return met.withColumn("_rank", F.explode(F.sequence(begin, end - 1))).select(
        *columns, "shard", (F.col("_base") + F.col("_rank") - F.col("_from")).alias("slot")
    )


def arc_of(position: int, positions: list[int]) -> int:
    """The arc of a position, for tests."""
    return bisect_right(positions, position - 1) % len(positions)


def document_shards(docs: DataFrame, shards: int, nodes: int = NODES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs (doc_id, text).

    The law is `rows`: the ring's loads are bounded without slack, so the counts of any two shards differ by
    one at most. size is the UTF-8 bytes of the text and 8 more; a null text has none, and the crc of an
    empty one. Equal rows are placed one after the other on the ring. grown_shard is null, as another shard
    count moves rows between all shards under this law.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = bounded_ring_shards(keys, ["doc_id", "size", "text_crc32"], shards, 0.0, nodes)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
