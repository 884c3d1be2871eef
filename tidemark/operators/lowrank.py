"""Truncated singular value decomposition of a long matrix by randomised subspace iteration.

A basis of `rank` + `more` directions of the column space is kept as a table, one vector a column; so is its image,
one vector a row. A step multiplies the matrix, block by block, with one of them and makes the result
orthonormal by a tall-skinny QR: every task reduces its rows to one small triangle, triangles are stacked
eight at a time until one is left. Only triangles of the basis' width reach the driver, never a row or a column
of the matrix. Where the basis spans all columns no iteration is needed and the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

BLOCK_ENTRIES = 500_000  # of the matrix that a task multiplies at once
BLOCK_NUMBERS = 4_000_000  # of vectors that a task holds at once
FANIN = 8
ROUNDS = 40  # most steps
SETTLED = 1e-9  # relative change of the singular values after which the steps end
MORE = 20
VECTORS = "id bigint, v array<double>"


def _vectors(ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(ids) + 1, dtype=np.int32) * values.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["id", "v"])


def _values(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[starts], np.add.reduceat(values[order], starts, axis=0)


def product(entries: DataFrame, vectors: DataFrame, width: int, n_entries: int) -> DataFrame:
    """(id, v): the sum over a row's entries (i, j, w) of w times the vector j.

    Entries meet vectors in blocks of j. A block is cut by i as well, so that a column that fills the matrix is
    several tasks; each of them gets the block's vectors. Partial sums are added in blocks of i.
    """
    rows = max(1, BLOCK_NUMBERS // width)  # vectors that a task may hold
    n_vectors = vectors.count()
    blocks = max(1, math.ceil(n_vectors / rows))
    cuts = max(1, math.ceil(n_entries / (blocks * min(BLOCK_ENTRIES, 16 * rows))))
    block = F.pmod(F.xxhash64("j"), F.lit(blocks))
    left = entries.select(block.alias("block"), F.pmod(F.xxhash64("i"), F.lit(cuts)).alias("cut"), "i", "j", "w")
    right = vectors.select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("cut"), "id", "v"
    ).withColumn("cut", F.col("cut").cast("bigint"))

    def multiply(cell: pa.Table, held: pa.Table) -> pa.Table:
        if not cell.num_rows or not held.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64()))})
        ids = held["id"].to_numpy()
        order = np.argsort(ids)
        values = _values(held["v"], width)[order]
        i, j, w = (cell[c].to_numpy() for c in ("i", "j", "w"))
        at = np.searchsorted(ids[order], j)
        by_row = np.argsort(i, kind="stable")
        parts = []
        for begin in range(0, len(by_row), rows):
            some = by_row[begin:begin + rows]
            parts.append(_vectors(*_sums(i[some], w[some, None] * values[at[some]])))
        return pa.Table.from_batches(parts)

    parts = left.groupBy("block", "cut").cogroup(right.groupBy("block", "cut")).applyInArrow(multiply, VECTORS)
    if blocks == 1 and n_entries <= rows:
        return parts
    # A row has a part for each block of j and one more where a part of it was cut: few in each group.
    groups = max(1, math.ceil(n_entries / rows))

    def add(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_vectors(*_sums(group["id"].to_numpy(), _values(group["v"], width)))])

    return parts.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups))).groupBy("group").applyInArrow(add, VECTORS)


def triangle(vectors: DataFrame, width: int) -> np.ndarray:
    """The triangular factor R (width x width) of the vectors as rows of a matrix, by a tree of small QRs."""
    rows = max(1, BLOCK_NUMBERS // width)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            values = _values(batch.column(0), width)
            for begin in range(0, len(values), rows):
                r = np.linalg.qr(np.vstack([r, values[begin:begin + rows]]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    level = stage(vectors.select("v").mapInArrow(reduce, "r binary").withColumn("n", F.monotonically_increasing_id()), "triangles")

    def stack(group: pa.Table) -> pa.Table:
        held = [np.frombuffer(r, np.float64).reshape(-1, width) for r in group["r"].to_pylist()]
        return pa.table({"r": pa.array([np.linalg.qr(np.vstack(held), mode="r").tobytes()], pa.binary())})

    while (count := level.count()) > 1:
        groups = math.ceil(count / FANIN)
        dealt = level.withColumn("g", F.pmod(F.xxhash64("n"), F.lit(groups)))
        level = stage(dealt.groupBy("g").applyInArrow(stack, "r binary").withColumn("n", F.monotonically_increasing_id()), "triangles")
    found = level.select("r").first()  # one triangle of the basis' width
    return np.frombuffer(found["r"], np.float64).reshape(-1, width) if found else np.zeros((0, width))


def turned(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(id, v @ matrix); the matrix is as wide as the basis."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _vectors(batch.column(0).to_numpy(), _values(batch.column(1), matrix.shape[0]) @ matrix)

    return vectors.select("id", "v").mapInArrow(run, VECTORS)


def orthonormal(vectors: DataFrame, width: int, smallest: float) -> tuple[DataFrame, np.ndarray, int]:
    """The vectors in an orthonormal basis, their singular values and how many columns are left; staged.

    Directions below `smallest` of the largest are dropped; a second turn takes back what rounding left.
    """
    singular = None
    for _ in range(2):
        _, s, wt = np.linalg.svd(triangle(vectors, width), full_matrices=False)
        singular = s if singular is None else singular
        kept = s > smallest * s[0] if len(s) and s[0] > 0 else np.zeros(len(s), bool)
        width = int(kept.sum())
        if not width:
            return vectors, singular, 0
        vectors = stage(turned(vectors, wt[kept].T / s[kept]), "basis")
    return vectors, singular, width


def _start(columns: DataFrame, width: int, seed: int) -> DataFrame:
    """A vector of independent normal numbers for each column id, the same at every run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = ids.astype(np.uint64)[:, None] * np.uint64(2 * width) + np.arange(2 * width, dtype=np.uint64) + np.uint64(seed << 40)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53
            radius, angle = np.sqrt(-2 * np.log(1 - u[:, :width])), 2 * np.pi * u[:, width:]
            yield _vectors(ids, radius * np.cos(angle))

    return columns.select("id").mapInArrow(run, VECTORS)


def _identity(columns: DataFrame, width: int) -> DataFrame:
    """The unit vector of each column id below `width`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            yield _vectors(ids, np.eye(width)[ids])

    return columns.select("id").mapInArrow(run, VECTORS)


def scaled_left_vectors(
    entries: DataFrame, columns: DataFrame, k: int, smallest: float = 1e-9, more: int = MORE, rounds: int = ROUNDS, seed: int = 7
) -> tuple[DataFrame, np.ndarray]:
    """(id, v) with v the row's k numbers of U * diag(s), and s, of the matrix with entries (i, j, w).

    `columns` is (id) 0..n-1 of the columns. Singular values at or below `smallest` times the first are dropped,
    so there may be fewer than k. The basis has 2 * k + `more` directions; where that covers all columns
    the result is exact, else the steps go on until the first k singular values settle (`rounds` at most).
    Entries of zero count for nothing: a matrix of zeros has no directions and no rows.
    """
    entries = entries.where("w <> 0")
    n_columns, n_entries = columns.count(), entries.count()
    if not n_entries:
        return entries.sparkSession.createDataFrame([], VECTORS), np.zeros(0)
    width = min(n_columns, 2 * k + more)
    flipped = entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")
    if width == n_columns:
        image = stage(product(entries, _identity(columns, width), width, n_entries), "image")
    else:
        image = stage(product(entries, stage(_start(columns, width, seed), "start"), width, n_entries), "image")
        before = None
        for _ in range(rounds):
            rows, _, width = orthonormal(image, width, smallest)
            basis, singular, width = orthonormal(stage(product(flipped, rows, width, n_entries), "basis"), width, smallest)
            image = stage(product(entries, basis, width, n_entries), "image")
            now = singular[:k]
            if before is not None and len(now) == len(before) and np.all(np.abs(now - before) <= SETTLED * now[0]):
                break
            before = now
    _, s, wt = np.linalg.svd(triangle(image, width), full_matrices=False)
    kept = np.flatnonzero(s > smallest * s[0])[:k]
    return turned(image, wt[kept].T), s[kept]
