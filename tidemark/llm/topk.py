"""Exact top-k inner products with block-at-a-time pruning.

Vectors of integers are kept in blocks of consecutive rows of one order, with each component's largest and
smallest value in the block. Their weighted sum bounds every score in the block for a query. A query takes
the blocks in the order of that bound and scores a block through its forward index (the rows themselves),
until the next bound is below its k-th score. Before that, each query scores the best-bounded block of all,
so every task starts from a k-th score to beat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.vectors import finite, matrix_of, principal_directions, unit
from tidemark.session import stage

SCALE = 1024
K = 10
BLOCK = 256  # rows of a block
SHARD = 64  # blocks of a tile
CHUNK = 1024  # queries of a tile
EXACT = float(1 << 53)


def integer_rows(table: DataFrame, leading: int = 8) -> DataFrame:
    """(vec_id, d, code, v): components floor(SCALE * x) as doubles, code the signs along the leading principal directions.

    Rows whose vector is null or holds null or non-finite components are left out.
    """
    usable = table.where(finite(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    sent = table.sparkSession.sparkContext.broadcast(principal_directions(usable, "embedding", leading))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix_of(batch.column(1))
            codes = []
            for r in rows:
                signs = (unit(r[None, :]) @ sent.value[len(r)])[0] > 0
                codes.append(int(np.dot(signs, 1 << np.arange(len(signs))[::-1])))
            whole = [np.floor(SCALE * r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) for r in rows], pa.int32()), pa.array(codes, pa.int64()), pa.array([w.tolist() for w in whole], pa.list_(pa.float64()))],
                ["vec_id", "d", "code", "v"],
            )

    return usable.mapInArrow(run, "vec_id bigint, d int, code bigint, v array<double>")


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """(part, nth, d, ids, matrix, low, high): runs of at most `size` rows in the order of d, code, vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            nonlocal nth, held
            order = sorted(range(len(held)), key=lambda i: held[i][0])
            m = np.array([held[i][1] for i in order]).reshape(len(held), -1)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([m.shape[1]], pa.int32()),
                    pa.array([[held[i][0] for i in order]], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary()),
                    pa.array([m.min(axis=0).tobytes()], pa.binary()), pa.array([m.max(axis=0).tobytes()], pa.binary()),
                ],
                ["part", "nth", "d", "ids", "matrix", "low", "high"],
            )
            nth, held = nth + 1, []
            return out

        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), matrix_of(batch.column(1)), strict=True):
                if held and (len(held) == size or len(held[0][1]) != len(v)):
                    yield flush()
                held.append((vec_id, v))
        if held:
            yield flush()

    return rows.orderBy("d", "code", "vec_id").select("vec_id", "v").mapInArrow(
        run, "part int, nth int, d int, ids array<bigint>, matrix binary, low binary, high binary"
    )


def products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of whole doubles: as doubles where no sum can leave their range, else as Python numbers."""
    if q.size == 0 or m.size == 0 or np.abs(q).max() * np.abs(m).max() * q.shape[1] < EXACT:
        return q @ m.T
    return np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in m] for x in q], dtype=object)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, blocks) summed maxima: no row of the block has a higher product with the query."""
    up = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    return up + np.abs(up) * 1e-12  # sums beyond 2^53 are rounded


def apart(frame: DataFrame) -> DataFrame:
    """The same columns under identities of their own, to be grouped beside a table of the same origin."""
    return frame.toDF(*frame.columns)


class Best:
    """The k best (score, id) of each query: higher score, then smaller id."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray) -> None:
        self.own, self.k = ids, k
        self.floor = floor.copy()  # scores below can't be among the k best
        self.found: list[list[tuple]] = [[] for _ in ids]

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.floor[which][:, None]
        for n in np.flatnonzero(keep.any(axis=1)):
            i = which[n]
            new = [(-s, x) for s, x in zip(scores[n, keep[n]].tolist(), ids[keep[n]].tolist(), strict=True) if x != self.own[i]]
            self.found[i] = sorted(self.found[i] + new)[:self.k]
            if len(self.found[i]) == self.k:
                self.floor[i] = max(self.floor[i], -self.found[i][-1][0])


def search_tile(q: np.ndarray, ids: np.ndarray, floor: np.ndarray, blocks: list[tuple], k: int) -> tuple[Best, int]:
    """The best of the queries among the blocks (ids, matrix, low, high), and how many (query, block) pairs were scored."""
    best, scored = Best(ids, k, floor), 0
    up = bounds(q, np.array([b[2] for b in blocks]), np.array([b[3] for b in blocks]))
    order = np.argsort(-up, axis=1, kind="stable")
    for turn in range(len(blocks)):
        at = order[:, turn]
        alive = np.flatnonzero(up[np.arange(len(q)), at] >= best.floor)
        if not len(alive):
            break
        for b in np.unique(at[alive]):
            which = alive[at[alive] == b]
            best.add(which, products(q[which], blocks[b][1]), blocks[b][0])
            scored += len(which)
    return best, scored


def _long(x: float) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(x)))


def top_products(table: DataFrame, every: int = 100, k: int = K, block: int = BLOCK, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k best other rows.

    Ties go to the smaller vec_id; ranks start at 1; fewer rows are given where there are fewer. Only rows of
    the query's dimension are compared. Rows with a null id, or a vector that is null or holds null or
    non-finite components, take no part; an empty vector scores 0 with other empty ones. A query doesn't meet
    rows of its own vec_id; of rows repeated with one vec_id, each is a candidate and the smallest
    vector asks. Scores beyond a 64-bit integer are cut to it. Other columns are not read.

    Queries in chunks meet blocks in shards: what moves is each query once for a shard and each block once for
    a chunk.
    """
    rows = stage(integer_rows(table), "integer-vectors")
    blocks = stage(blocks_of(rows, block), "vector-blocks")
    tiles = blocks.withColumn("shard", F.concat_ws(":", "d", "part", F.floor(F.col("nth") / shard)))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("d", "v")).alias("q")).select("vec_id", "q.d", "q.v")
    n_asked = asked.count()
    chunks = max(1, -(-n_asked // chunk))
    asked = stage(asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")), "queries")
    seeds = seed_floors(asked, tiles, k)
    seeded = asked.join(seeds, "vec_id", "left")
    shards = tiles.select("shard", "d").distinct()
    left = seeded.join(shards, "d")
    each = asked.select("d", "chunk").distinct()
    right = apart(tiles.join(each, "d"))

    def run(queries: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(part):
            q = np.array(queries["v"].tolist()).reshape(len(queries), -1)
            floor = queries["floor"].fillna(-np.inf).to_numpy(np.float64)
            d = q.shape[1]
            own = [
                (np.asarray(b.ids), np.frombuffer(b.matrix).reshape(len(b.ids), d), np.frombuffer(b.low), np.frombuffer(b.high))
                for b in part.itertuples()
            ]
            best, _ = search_tile(q, queries["vec_id"].to_numpy(), floor, own, k)
            out = [(int(i), int(x), _long(-s)) for i, found in zip(best.own, best.found, strict=True) for s, x in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    met = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInPandas(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def seed_floors(asked: DataFrame, tiles: DataFrame, k: int) -> DataFrame:
    """(vec_id, floor): the k-th score of each query within the block whose bound is best for it.

    Bounds need the blocks' extremes only. A floor may only rise to it: the true k-th score is at least as high.
    """
    extremes = tiles.select("shard", "part", "nth", "d", "low", "high")
    shards = tiles.select("shard", "d").distinct()
    each = asked.select("d", "chunk").distinct()

    def first(queries: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(part):
            return pd.DataFrame({"vec_id": [], "part": [], "nth": [], "up": []}).astype({"vec_id": "int64", "part": "int32", "nth": "int32", "up": "float64"})
        q = np.array(queries["v"].tolist()).reshape(len(queries), -1)
        up = bounds(q, np.array([np.frombuffer(x) for x in part["low"]]), np.array([np.frombuffer(x) for x in part["high"]]))
        at = up.argmax(axis=1)
        return pd.DataFrame({
            "vec_id": queries["vec_id"].to_numpy(), "part": part["part"].to_numpy()[at], "nth": part["nth"].to_numpy()[at],
            "up": up[np.arange(len(q)), at],
        })

    bests = (
        asked.join(shards, "d").groupBy("shard", "chunk")
        .cogroup(apart(extremes.join(each, "d")).groupBy("shard", "chunk"))
        .applyInPandas(first, "vec_id bigint, part int, nth int, up double")
    )
    chosen = bests.groupBy("vec_id").agg(F.max_by(F.struct("part", "nth"), "up").alias("b")).select("vec_id", "b.part", "b.nth")
    queries = asked.join(chosen, "vec_id").select("vec_id", "chunk", "v", "part", "nth")
    wanted = queries.select("part", "nth", "chunk").distinct().join(tiles.select("part", "nth", "ids", "matrix"), ["part", "nth"])

    def kth(queries: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(part):
            b = part.iloc[0]
            ids = np.asarray(b["ids"])
            m = np.frombuffer(b["matrix"]).reshape(len(ids), -1)
            scores = products(np.array(queries["v"].tolist()).reshape(len(queries), -1), m)
            for vec_id, row in zip(queries["vec_id"], scores, strict=True):
                others = np.sort(row[ids != vec_id].astype(np.float64))
                if len(others) >= k:
                    out.append((vec_id, np.nextafter(float(others[-k]), -np.inf)))
        return pd.DataFrame(out, columns=["vec_id", "floor"]).astype({"vec_id": "int64", "floor": "float64"})

    key = ["part", "nth", "chunk"]
    return queries.groupBy(*key).cogroup(apart(wanted).groupBy(*key)).applyInPandas(kth, "vec_id bigint, floor double")
