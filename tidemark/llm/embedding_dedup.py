"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine of at least c are at most eps = sqrt(2 - 2c) apart, and so are their projections
on any orthonormal directions. Vectors are sorted by their grid cells (edge eps) on the leading principal
directions and cut into sequence intervals. The join starts from one interval that holds all and goes down:
a pair of intervals becomes the pairs of their parts, and pairs whose boxes are more than eps apart are
dropped, until intervals are blocks of rows, which a task multiplies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.vectors import finite, matrix_of, principal_directions, unit
from tidemark.session import stage

COSINE = 0.98
LEADING = 8
BLOCK = 256  # vectors of a leaf interval
PARTS = 16  # parts of an interval
SLACK = 1e-9  # of distances and projections in double precision
SPREAD = 64  # pairs of one block are dealt over so many groups


def distinct_vectors(table: DataFrame) -> DataFrame:
    """(rep, label, embedding, weight): equal vectors of a label once; rep is their smallest id."""
    usable = table.where(finite(F.col("embedding")) & F.col("label").isNotNull()).where(
        F.exists(F.col("embedding"), lambda x: x != 0)
    )
    return usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))


def grid_order(kinds: DataFrame, leading: int, eps: float) -> DataFrame:
    """(node, label, embedding, weight, cells, point) sorted by label, dimension and cells, over range partitions."""
    directions = principal_directions(kinds, "embedding", leading)
    sent = kinds.sparkSession.sparkContext.broadcast(directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix_of(batch.column(2))
            points = [(unit(r[None, :]) @ sent.value[len(r)])[0] for r in rows]
            cells = [np.floor(p / eps).astype(np.int32).tolist() for p in points]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.list_(pa.int32())), pa.array([p.tolist() for p in points], pa.list_(pa.float64()))],
                ["node", "label", "embedding", "weight", "cells", "point"],
            )

    placed = kinds.mapInArrow(
        run, "node bigint, label bigint, embedding array<double>, weight bigint, cells array<int>, point array<double>"
    )
    placed = stage(placed.withColumn("dim", F.size("embedding")), "grid-points")
    return placed.orderBy("label", "dim", "cells", "node")


def leaf_blocks(ordered: DataFrame, block: int) -> DataFrame:
    """(part, nth, label, dim, low, high, nodes, weights, matrix): runs of at most `block` rows of one label and dimension.

    low and high bound the projections; matrix holds the unit vectors as doubles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal nth, held
            key = held[0][0]
            points = np.array([h[1] for h in held])
            matrix = unit(np.array([h[2] for h in held]))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()),
                    pa.array([points.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([points.max(axis=0).tolist()], pa.list_(pa.float64())),
                    pa.array([[h[3] for h in held]], pa.list_(pa.int64())), pa.array([[h[4] for h in held]], pa.list_(pa.int64())),
                    pa.array([matrix.tobytes()], pa.binary()),
                ],
                ["part", "nth", "label", "dim", "low", "high", "nodes", "weights", "matrix"],
            )
            nth, held = nth + 1, []
            return out

        for batch in batches:
            nodes, labels, vectors, weights, points = (batch.column(i) for i in range(5))
            for node, label, vector, weight, point in zip(
                nodes.to_pylist(), labels.to_pylist(), matrix_of(vectors), weights.to_pylist(), matrix_of(points), strict=True
            ):
                key = (label, len(vector))
                if held and (len(held) == block or held[0][0] != key):
                    yield flush()
                held.append((key, point, vector, node, weight))
        if held:
            yield flush()

    return ordered.select("node", "label", "embedding", "weight", "point").mapInArrow(
        run,
        "part int, nth int, label bigint, dim int, low array<double>, high array<double>, nodes array<bigint>, "
        "weights array<bigint>, matrix binary",
    )


def _gap(a: str, b: str) -> Column:
    """Squared distance of two boxes."""
    sides = F.zip_with(
        F.arrays_zip(F.col(f"{a}_low").alias("l"), F.col(f"{a}_high").alias("h")),
        F.arrays_zip(F.col(f"{b}_low").alias("l"), F.col(f"{b}_high").alias("h")),
        lambda x, y: F.greatest(x["l"] - y["h"], y["l"] - x["h"], F.lit(0.0)),
    )
    return F.aggregate(sides, F.lit(0.0), lambda s, x: s + x * x)


def interval_pairs(leaves: DataFrame, eps: float, parts: int = PARTS) -> DataFrame:
    """(a, b), a <= b: leaf intervals of one label and dimension whose boxes are at most eps apart.

    `leaves` is (leaf, label, dim, low, high), leaf numbering the sequence from 0. An interval of a level is
    `parts` of the next. Upper intervals may hold several labels; those are only told apart by their ranges.
    """
    n = leaves.count()
    heights = [1]
    while heights[-1] < n:
        heights.append(heights[-1] * parts)
    longest = leaves.agg(F.max(F.size("low"))).collect()[0][0] or 0

    def box(height: int) -> DataFrame:
        if height == 1:
            return leaves.select(F.col("leaf").alias("id"), F.col("label").alias("l0"), F.col("label").alias("l1"),
                                 F.col("dim").alias("d0"), F.col("dim").alias("d1"), "low", "high")
        coordinate = [F.min(F.get("low", F.lit(i))).alias(f"m{i}") for i in range(longest)]
        coordinate += [F.max(F.get("high", F.lit(i))).alias(f"n{i}") for i in range(longest)]
        bounds = leaves.groupBy(F.floor(F.col("leaf") / height).cast("bigint").alias("id")).agg(
            F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("dim").alias("d0"), F.max("dim").alias("d1"), *coordinate
        )
        # Boxes of mixed dimensions can't be compared by coordinates: they stay open.
        same = F.col("d0") == F.col("d1")
        empty = F.array().cast("array<double>")
        known = [F.filter(F.array(*[F.col(f"{c}{i}") for i in range(longest)]), lambda x: x.isNotNull()) if longest else empty for c in "mn"]
        return bounds.select("id", "l0", "l1", "d0", "d1", F.when(same, known[0]).otherwise(empty).alias("low"),
                             F.when(same, known[1]).otherwise(empty).alias("high"))

    pairs = leaves.sparkSession.createDataFrame([(0, 0)] if n else [], "a bigint, b bigint")
    for height in heights[:-1][::-1] or [1]:
        boxes = stage(box(height), "interval-boxes")
        under = boxes.withColumn("above", F.floor(F.col("id") / parts).cast("bigint"))
        left = under.select(F.col("above").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("id", "l0", "l1", "d0", "d1", "low", "high")])
        right = under.select(F.col("above").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("id", "l0", "l1", "d0", "d1", "low", "high")])
        near = pairs.join(left, "a").join(right, "b").where("a_id <= b_id and a_l0 <= b_l1 and b_l0 <= a_l1 and a_d0 <= b_d1 and b_d0 <= a_d1")
        comparable = (F.size("a_low") > 0) & (F.size("b_low") > 0) & (F.size("a_low") == F.size("b_low"))
        near = near.where(~comparable | (_gap("a", "b") <= (eps + SLACK) ** 2))
        pairs = stage(near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "interval-pairs")
    return pairs


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Some of the set cells of a matrix, less than rows + columns, that connect the same rows and columns."""
    out, rows_left = [], links.any(axis=1)
    seen_rows, seen_columns = np.zeros(links.shape[0], bool), np.zeros(links.shape[1], bool)
    for r in np.flatnonzero(rows_left):
        if seen_rows[r]:
            continue
        seen_rows[r] = True
        todo = [(0, int(r))]
        while todo:
            side, i = todo.pop()
            if side == 0:
                for c in np.flatnonzero(links[i] & ~seen_columns):
                    seen_columns[c] = True
                    out.append((i, int(c)))
                    todo.append((1, int(c)))
            else:
                for q in np.flatnonzero(links[:, i] & ~seen_rows):
                    seen_rows[q] = True
                    out.append((int(q), i))
                    todo.append((0, int(q)))
    return out


def block_links(pairs: DataFrame, blocks: DataFrame, cosine: float, spread: int = SPREAD) -> DataFrame:
    """(node, n, other): partial numbers of linked rows (other null), and links that connect all that is linked (n 0).

    The pairs of a block are dealt over `spread` groups by the hash of the other block. A task holds one
    block and meets the others one by one; it gives at most one count and one link for each row of a pair.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        counts: dict[int, int] = {}
        links: list[tuple[int, int]] = []

        def count(nodes: list[int], numbers: np.ndarray) -> None:
            for i in np.flatnonzero(numbers):
                counts[nodes[i]] = counts.get(nodes[i], 0) + int(numbers[i])

        if len(left) and len(right):
            own = left.iloc[0]
            x = np.frombuffer(own["matrix"]).reshape(len(own["nodes"]), -1)
            for other in right.itertuples():
                y = np.frombuffer(other.matrix).reshape(len(other.nodes), -1)
                near = x @ y.T >= cosine
                if other.b == own["a"]:
                    np.fill_diagonal(near, False)
                    count(own["nodes"], near @ np.asarray(other.weights))
                    near = np.triu(near)
                else:
                    count(own["nodes"], near @ np.asarray(other.weights))
                    count(other.nodes, np.asarray(own["weights"]) @ near)
                links += [(int(own["nodes"][r]), int(other.nodes[c])) for r, c in spanning(near)]
        nodes = list(counts)
        return pd.DataFrame({
            "node": np.array(nodes + [a for a, _ in links], np.int64),
            "n": np.array([counts[k] for k in nodes] + [0] * len(links), np.int64),
            "other": pd.array([None] * len(nodes) + [b for _, b in links], dtype="Int64"),
        })

    dealt = pairs.withColumn("group", F.pmod(F.xxhash64("b"), F.lit(spread)).cast("int"))
    data = blocks.select("leaf", "nodes", "weights", "matrix")
    left = dealt.select("a", "group").distinct().join(data.withColumnRenamed("leaf", "a"), "a")
    right = dealt.join(data.withColumnRenamed("leaf", "b"), "b")
    right = right.toDF(*right.columns)  # columns of its own, for the grouping below
    return left.groupBy("a", "group").cogroup(right.groupBy("a", "group")).applyInPandas(run, "node bigint, n bigint, other bigint")


def near_duplicate_vectors(
    table: DataFrame, cosine: float = COSINE, leading: int = LEADING, block: int = BLOCK, parts: int = PARTS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of table (vec_id, embedding, label).

    Two rows are linked when their labels are equal and not null, their dimensions are equal and their
    cosine in double precision is at least `cosine`. n_links counts the other rows linked directly,
    component_id is the smallest vec_id reachable, kept says that it is the row's own.

    Equal vectors of a label are joined once and counted by their number, so a vector may repeat without
    limit. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and
    are their own component. Repeated rows are linked rows each. Other columns of table are not read. No
    rows in, no rows out.
    """
    eps = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine)))
    table = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("bigint").alias("label"))
    kinds = stage(distinct_vectors(table).withColumn("node", F.xxhash64("label", "embedding")), "distinct-vectors")
    ordered = grid_order(kinds.select("node", "label", "embedding", "weight"), leading, max(eps, 1e-6))
    blocks = stage(leaf_blocks(ordered, block), "vector-blocks")
    sizes = blocks.groupBy("part").agg(F.max("nth").alias("nth")).orderBy("part").collect()  # one row for each task
    starts, total = [], 0
    for row in sizes:
        starts.append((row["part"], total))
        total += row["nth"] + 1
    offsets = table.sparkSession.createDataFrame(starts, "part int, start bigint")
    blocks = blocks.join(offsets, "part").withColumn("leaf", F.col("start") + F.col("nth"))
    pairs = interval_pairs(blocks.select("leaf", "label", "dim", "low", "high"), eps, parts)
    found = stage(block_links(pairs, blocks, cosine), "vector-links")
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.where("other is not null").select("node", "other"), "node", "other")
    placed = stage(
        kinds.select("node", "rep", "weight").join(counts, "node", "left").join(roots, "node", "left")
        .select("node", "rep", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")),
        "placed-vectors",
    )
    classes = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    lookup = placed.join(classes, "root").select("node", "n_links", "component_id")
    usable = finite(F.col("embedding")) & F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0)
    rows = table.select("vec_id", F.when(usable, F.xxhash64("label", "embedding")).alias("node"))
    return rows.join(lookup, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
