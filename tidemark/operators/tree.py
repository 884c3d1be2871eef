"""Request trees of sessions, as one table of nodes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.urls import dataset_id, event_class, request_path, site_referer
from tidemark.operators.sessions import SESSION, session_requests

KEYS = ("datasetlist", "dataset", "ftp")

NODE_SCHEMA = (
    "month string, ip string, session_id string, seq int, epoch bigint, key string, request string, "
    "dataset_id string, parent_seq int, parent_key string, n_children int, downloaded boolean, "
    "search_url string"
)

FLUSH_ROWS = 10_000


def _node(row: dict, parent: dict | None) -> dict:
    above = None
    if parent is not None:
        above = parent["request"] if parent["key"] == "datasetlist" else parent["search_url"]
        parent["n_children"] += 1
        parent["downloaded"] |= row["key"] == "ftp"
    return {
        **row, "parent_seq": parent["seq"] if parent else 0,
        "parent_key": parent["key"] if parent else "root",
        "n_children": 0, "downloaded": False, "search_url": above,
    }


def referer_tree(rows: list[dict]) -> list[dict]:
    """Nodes of one session whose parents are found by referer.

    The tree starts at the first search page. A request equal to the one inserted last is skipped. Search
    pages hang under the latest earlier node with their referer, else under the root; dataset pages need
    such a node; transfers hang under the latest dataset page.
    """
    nodes: list[dict] = []
    by_request: dict[str, dict] = {}
    view = None
    for row in rows:
        key, referer = row["key"], row.pop("referer")
        if (not nodes and key != "datasetlist") or (nodes and nodes[-1]["request"] == row["request"]):
            continue
        parent = view if key == "ftp" else (None if referer == "-" else by_request.get(referer))
        if parent is None and key != "datasetlist":
            continue
        node = _node(row, parent)
        nodes.append(node)
        by_request[node["request"]] = node
        if key == "dataset":
            view = node
    return nodes


def _first_fit_nodes(rows: DataFrame) -> DataFrame:
    """Nodes placed by kind alone, from the first search page on.

    First fit leaves one open place per kind: a search or dataset page goes under the latest search page,
    a transfer under the first dataset page. So parents and counts of children are windows over the
    session, none of which gathers rows.
    """
    whole = Window.partitionBy(*SESSION)
    w = whole.orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    is_list, is_view, is_ftp = (F.col("key") == k for k in KEYS)
    started = rows.withColumn("_top", F.min(F.when(is_list, F.col("seq"))).over(whole)).where("seq >= _top")
    placed = (
        started.withColumn("_search", F.last(F.when(is_list, F.struct("seq", "request")), ignorenulls=True).over(before))
        .withColumn("_view", F.min(F.when(is_view, F.col("seq"))).over(whole))
        .withColumn("_part", F.count_if(is_list).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .where(~is_ftp | (F.col("_view") < F.col("seq")))
        .withColumn("_parts", F.max("_part").over(whole))
        .withColumn("_transfers", F.count_if(is_ftp).over(whole))
        .withColumn("_pages", F.count_if(is_view).over(Window.partitionBy(*SESSION, "_part")))
        .withColumn("_above", F.max(F.when(F.col("seq") == F.col("_view"), F.col("_search.request"))).over(whole))
    )
    takes = F.col("seq") == F.col("_view")
    children = (
        F.when(is_list, F.col("_pages") + F.when(F.col("_part") < F.col("_parts"), 1).otherwise(0))
        .when(takes, F.col("_transfers")).otherwise(0)
    )
    parent = F.when(is_ftp, F.col("_view")).otherwise(F.coalesce("_search.seq", F.lit(0)))
    return placed.select(
        *SESSION, "seq", "epoch", "key", "request", "dataset_id", parent.cast("int").alias("parent_seq"),
        F.when(is_ftp, "dataset").when(parent > 0, "datasetlist").otherwise("root").alias("parent_key"),
        children.cast("int").alias("n_children"),
        (takes & (F.col("_transfers") > 0)).alias("downloaded"),
        F.when(is_ftp, F.col("_above")).otherwise(F.col("_search.request")).alias("search_url"),
    )


PASSED = ("month", "ip", "session_id", "seq", "epoch", "key", "request", "dataset_id")
GROWN = (
    ("parent_seq", pa.int32()), ("parent_key", pa.string()), ("n_children", pa.int32()), ("downloaded", pa.bool_()),
    ("search_url", pa.string()),
)
READ = ("seq", "key", "request", "referer")


def _trees(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole sessions. Only what the tree is built from becomes Python values; other columns are taken as they are."""
    if not held:
        return
    whole = pa.Table.from_batches(held).combine_chunks()
    starts, rows = whole.column("_starts").to_pylist(), zip(*[whole.column(c).to_pylist() for c in READ])
    nodes, session = [], []
    for at, (seq, key, request, referer) in enumerate(rows):
        if starts[at]:
            nodes.extend(referer_tree(session))
            session = []
        session.append({"at": at, "seq": seq, "key": key, "request": request, "referer": referer})
    nodes.extend(referer_tree(session))
    kept = whole.select(PASSED).take(pa.array([n["at"] for n in nodes], pa.int64()))
    for name, kind in GROWN:
        kept = kept.append_column(name, pa.array([n[name] for n in nodes], kind))
    yield from kept.combine_chunks().to_batches(max_chunksize=FLUSH_ROWS)


def _grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []  # the last session may go on in the next batch
    for batch in batches:
        starts = np.flatnonzero(batch.column("_starts").to_numpy(zero_copy_only=False))
        if len(starts):
            last = int(starts[-1])
            yield from _trees([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    yield from _trees(held)


def session_tree(
    log: DataFrame, site: str, mode: str = "referer", limit: int | None = None
) -> DataFrame:
    """Tree nodes of every session (root left out; its children have parent_seq 0).

    Where a node hangs depends on which earlier nodes were kept, so sessions are streamed one at a time,
    whole unless a ``limit`` is given. Numbering the requests has already brought every session together
    in time order; the sort states that order and costs no second shuffle. Rows before a session's first
    search page can't be nodes and aren't sent to Python. Each node carries the nearest search above it
    (``search_url``); `ancestry` finds the others. Memory and output are linear in the session.
    """
    so_far = Window.partitionBy(*SESSION).orderBy("ts", "line_id").rowsBetween(Window.unboundedPreceding, 0)
    searches = F.count_if(event_class(F.col("log_type"), F.col("request")) == "datasetlist").over(so_far)
    rows = session_requests(log, limit).withColumn("_searches", searches).sortWithinPartitions(*SESSION, "ts", "line_id")
    path = F.when(F.col("log_type") == "http", request_path(F.col("request")))
    ordered = rows.select(
        *SESSION,
        F.col("seq").cast("int").alias("seq"),
        F.unix_seconds("ts").alias("epoch"),
        event_class(F.col("log_type"), F.col("request")).alias("key"),
        F.lower(F.coalesce(path, "request")).alias("request"),
        dataset_id(path).alias("dataset_id"),
        site_referer(F.col("referer"), site).alias("referer"), "_searches",
    ).where(F.col("key").isin(*KEYS))
    if mode == "first_fit":
        return _first_fit_nodes(ordered)
    started = ordered.where("_searches > 0").withColumn("_starts", (F.col("_searches") == 1) & (F.col("key") == "datasetlist"))
    return started.drop("_searches").mapInArrow(_grow, NODE_SCHEMA)


def view_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("key") == "dataset")


def leaf_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("n_children") == 0)


def download_leaves(nodes: DataFrame) -> DataFrame:
    return leaf_nodes(nodes).where(F.col("key") == "ftp")


# The icon of each kind of node in the rendered tree.
ICONS = {"datasetlist": "searching.png", "dataset": "viewing.png", "ftp": "downloading.png"}


def node_label(key: Column, request: Column, dataset: Column) -> Column:
    return F.when(key == "dataset", dataset).otherwise(request)


def node_icon(key: Column) -> Column:
    table = F.create_map(*[F.lit(part) for pair in ICONS.items() for part in pair])
    return F.try_element_at(table, key)


def render_tree(nodes: Column) -> Column:
    """Nested JSON of one session's nodes (array of structs with seq, parent_seq, icon, name).

    Children come after their parent, so one backward pass suffices: each node takes the finished
    subtrees that wait for it and then waits for its own parent.
    """
    waiting = F.array().cast("array<struct<parent:int,json:string>>")

    def take(pending: Column, n: Column) -> Column:
        own = F.array_join(
            F.transform(F.filter(pending, lambda p: p["parent"] == n["seq"]), lambda p: p["json"]), ","
        )
        head = F.to_json(F.struct(n["seq"].alias("seq"), n["icon"].alias("icon"), n["name"].alias("name")))
        json = F.concat(
            F.substring(head, F.lit(1), F.length(head) - 1),
            F.when(own != "", F.concat(F.lit(',"children":['), own, F.lit("]"))).otherwise(""),
            F.lit("}"),
        )
        entry = F.struct(n["parent_seq"].alias("parent"), json.alias("json"))
        return F.array_prepend(F.filter(pending, lambda p: p["parent"] != n["seq"]), entry)

    roots = F.aggregate(F.reverse(F.array_sort(nodes)), waiting, take)
    top = F.array_join(F.transform(roots, lambda p: p["json"]), ",")
    return F.concat(
        F.lit('{"seq":0,"name":"","icon":"users.png"'),
        F.when(top != "", F.concat(F.lit(',"children":['), top, F.lit("]"))).otherwise(""),
        F.lit("}"),
    )


def tree_json(nodes: DataFrame) -> DataFrame:
    """One nested JSON tree per session. The document is one value, so a session's nodes meet in one row."""
    node = F.struct(
        "seq", "parent_seq", node_icon(F.col("key")).alias("icon"),
        node_label(F.col("key"), F.col("request"), F.col("dataset_id")).alias("name"),
    )
    grouped = nodes.groupBy(*SESSION).agg(F.collect_list(node).alias("nodes"))
    return grouped.select(*SESSION, render_tree(F.col("nodes")).alias("tree"))


def newest_comments(comments: DataFrame, limit: int | None = None) -> DataFrame:
    """Per session its comments as one array, newest first; a ``limit`` ranks them before they are gathered."""
    w = Window.partitionBy("session_id").orderBy(F.desc("post_date"), F.desc("comment_id"))
    ranked = comments.withColumn("_rank", F.row_number().over(w))
    top = ranked if limit is None else ranked.where(F.col("_rank") <= limit)
    record = F.struct("_rank", "post_date", "who", "comment", "comment_id")
    return top.groupBy("session_id").agg(F.array_sort(F.collect_list(record)).alias("comments"))


def session_json(
    log: DataFrame, nodes: DataFrame, comments: DataFrame, keywords: DataFrame, limit: int | None = None,
    comment_limit: int | None = None,
) -> DataFrame:
    """One JSON document per session: request tree, request list, comments and keywords."""
    request = F.struct(
        "seq", F.unix_seconds("ts").alias("time"), "request", "request_url", "log_type", "referer"
    )
    lists = session_requests(log, limit).groupBy(*SESSION).agg(
        F.array_sort(F.collect_list(request)).alias("requests")
    )
    joined = (
        lists.join(tree_json(nodes), SESSION, "left")
        .join(newest_comments(comments, comment_limit), "session_id", "left")
        .join(keywords.select(*SESSION, "keywords"), SESSION, "left")
    )
    document = F.concat(
        F.lit('{"treeData":'), F.coalesce("tree", F.lit('{"seq":0,"name":"","icon":"users.png"}')),
        F.lit(',"RequestList":'), F.to_json("requests"),
        F.lit(',"Comments":'), F.coalesce(F.to_json("comments"), F.lit("[]")),
        F.lit(',"keywords":'), F.coalesce(F.to_json("keywords"), F.lit("[]")), F.lit("}"),
    )
    return joined.select(*SESSION, document.alias("document"))
