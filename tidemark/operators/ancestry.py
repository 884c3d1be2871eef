"""The searches above the nodes of request trees, found by path doubling over (seq, parent_seq).

No node carries a list and no session is gathered: pointers are rows, joined by session and place, so a hot session
spreads over tasks and a path of n searches takes about log2(n) joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sessions import SESSION
from tidemark.session import stage

SEARCH = "datasetlist"


def _pointers(table: DataFrame, at: str, *names: str) -> DataFrame:
    """The pointers of `table`, to be met where they start; other columns are renamed to `names`."""
    return table.select(*SESSION, F.col("seq").alias(at), *(F.col(c).alias(n) for c, n in zip(("up", "done"), names, strict=False)))


def nearest_searches(nodes: DataFrame) -> DataFrame:
    """(month, ip, session_id, seq, key, up): the seq of the nearest search strictly above each node, 0 if none is.

    Nodes are (month, ip, session_id, seq, parent_seq, key); a node whose parent is 0 or missing is under the root.
    A pointer that has not reached a search takes its target's, so their reach doubles each round.
    """
    own = nodes.select(*SESSION, "seq", "parent_seq", "key")
    parents = own.select(*SESSION, F.col("seq").alias("parent_seq"), F.col("key").alias("_above"))
    met = own.join(parents, [*SESSION, "parent_seq"], "left")
    done = F.col("_above").isNull() | (F.col("_above") == SEARCH)
    up = F.when(F.col("_above").isNull(), F.lit(0)).otherwise(F.col("parent_seq"))
    table = stage(met.select(*SESSION, "seq", "key", up.cast("int").alias("up"), done.alias("done")), "pointers")
    while not table.where("not done").isEmpty():
        open_ones = table.where("not done").withColumn("_at", F.col("up"))
        step = open_ones.join(_pointers(table, "_at", "_up", "_done"), [*SESSION, "_at"])
        moved = step.select(*SESSION, "seq", "key", F.col("_up").alias("up"), F.col("_done").alias("done"))
        table = stage(table.where("done").unionByName(moved), "pointers")
    return table.select(*SESSION, "seq", "key", "up")


def searches_above(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(month, ip, session_id, seq, k, search_seq, search_url): all searches above the asked nodes, k = 0 the nearest.

    `asked` holds distinct (month, ip, session_id, seq) of nodes. Round j knows each node's first 2^j searches and
    each search's 2^j-th one; the first join gives the next 2^j, the second doubles the reach.
    """
    nearest = stage(nearest_searches(nodes), "nearest")
    jumps = nearest.where((F.col("key") == SEARCH) & (F.col("up") > 0)).select(*SESSION, "seq", "up")
    known = stage(
        nearest.join(asked.select(*SESSION, "seq"), [*SESSION, "seq"], "left_semi").where("up > 0")
        .select(*SESSION, "seq", F.lit(0).cast("bigint").alias("k"), F.col("up").alias("search_seq")),
        "above",
    )
    found, reach = [known], 1
    while True:
        hops = _pointers(jumps, "search_seq", "_up")
        so_far = found[0]
        for part in found[1:]:
            so_far = so_far.unionByName(part)
        further = so_far.join(hops, [*SESSION, "search_seq"]).select(
            *SESSION, "seq", (F.col("k") + reach).alias("k"), F.col("_up").alias("search_seq")
        )
        further = stage(further, "above")
        if further.isEmpty():
            break
        found.append(further)
        twice = jumps.withColumn("_at", F.col("up")).join(_pointers(jumps, "_at", "_up"), [*SESSION, "_at"])
        jumps = stage(twice.select(*SESSION, "seq", F.col("_up").alias("up")), "jumps")
        reach *= 2
    urls = nodes.where(F.col("key") == SEARCH).select(
        *SESSION, F.col("seq").alias("search_seq"), F.col("request").alias("search_url")
    )
    return so_far.join(urls, [*SESSION, "search_seq"]).select(*SESSION, "seq", "k", "search_seq", "search_url")


def search_paths(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(month, ip, session_id, seq, search_path): the URLs above each asked node that has any, nearest first, as one value."""
    rows = searches_above(nodes, asked)
    ordered = F.array_sort(F.collect_list(F.struct("k", "search_url")))
    return rows.groupBy(*SESSION, "seq").agg(F.transform(ordered, lambda p: p["search_url"]).alias("search_path"))
