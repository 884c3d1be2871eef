"""Vectors in blocks: cleaning, principal directions, and a global order cut into blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components (also for an empty one); false for null."""
    value = vector.cast("array<double>")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad, F.lit(False))


def matrix_of(column: pa.Array) -> list[np.ndarray]:
    """Rows of a list column as double arrays."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum([0, *[len(x) for x in column]])
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, also where squares of the components would overflow or vanish."""
    big = np.abs(x).max(axis=1, keepdims=True) if x.size else np.ones((len(x), 1))
    x = x / np.where(big > 0, big, 1.0)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1.0)


def principal_directions(vectors: DataFrame, column: str, leading: int) -> dict[int, np.ndarray]:
    """For each dimension d that occurs, d x min(d, leading) orthonormal columns of most variance of the unit vectors.

    Tasks send one sum and one matrix of products for each dimension, which are added up in Spark; the driver
    holds d x d numbers. Any orthonormal columns keep results right; these keep blocks apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            groups: dict[int, list[np.ndarray]] = {}
            for row in matrix_of(batch.column(0)):
                groups.setdefault(len(row), []).append(row)
            for d, rows in groups.items():
                x = unit(np.array(rows).reshape(len(rows), d))
                one = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                sums[d] = sums.get(d, 0.0) + one.T @ one
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.ravel().tolist()])], ["d", "m"])

    parts = vectors.select(F.col(column).cast("array<double>")).mapInArrow(run, "d int, m array<double>")
    totals = parts.select("d", F.posexplode("m").alias("i", "x")).groupBy("d", "i").agg(F.sum("x").alias("x"))
    out: dict[int, np.ndarray] = {}
    for d, cells in totals.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("cells")).collect():
        m = np.array([c["x"] for c in cells]).reshape(d + 1, d + 1)
        mean = m[0, 1:] / m[0, 0]
        _, columns = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        out[d] = columns[:, ::-1][:, :leading].copy()
    return out
