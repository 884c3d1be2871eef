"""The decomposition against numpy's, with small blocks so that every path is walked."""

import numpy as np
import pytest

from tidemark.operators import lowrank, matrix


def entries_of(spark, a):
    rows = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    return spark.createDataFrame(rows, "i bigint, j bigint, w double").repartition(5)


def with_spectrum(rng, rows, columns, s):
    u = np.linalg.qr(rng.normal(size=(rows, len(s))))[0]
    v = np.linalg.qr(rng.normal(size=(columns, len(s))))[0]
    return u @ np.diag(s) @ v.T


@pytest.mark.parametrize("numbers", [lowrank.BLOCK_NUMBERS, 300])
def test_first_directions(spark, monkeypatch, numbers):
    """60 columns, a basis of 11: iterated. The product of the result with its transpose is that of the best rank."""
    monkeypatch.setattr(lowrank, "BLOCK_NUMBERS", numbers)
    rng = np.random.default_rng(1)
    a = with_spectrum(rng, 90, 60, [9.0, 7.5, 6.0, 5.0, *np.linspace(2, 0.1, 30)])
    columns = spark.range(60).select("id")
    got, s = lowrank.scaled_left_vectors(entries_of(spark, a), columns, 4, more=3)
    assert np.allclose(s, [9.0, 7.5, 6.0, 5.0], atol=1e-8)
    us = np.zeros((90, 4))
    for r in got.collect():
        us[r["id"]] = r["v"]
    u, sv, _ = np.linalg.svd(a, full_matrices=False)
    best = u[:, :4] * sv[:4]
    assert np.allclose(us @ us.T, best @ best.T, atol=1e-5)


def test_all_columns_and_missing_rank(spark):
    """A basis of all columns needs no steps; a matrix of rank 3 has three directions only."""
    rng = np.random.default_rng(2)
    a = with_spectrum(rng, 40, 12, [4.0, 2.0, 1.0])
    got, s = lowrank.scaled_left_vectors(entries_of(spark, a), spark.range(12).select("id"), 10)
    assert np.allclose(s, [4.0, 2.0, 1.0])
    us = np.zeros((40, 3))
    for r in got.collect():
        us[r["id"]] = r["v"]
    assert np.allclose(us @ us.T, a @ a.T)


def test_steps_with_missing_rank(spark):
    rng = np.random.default_rng(3)
    a = with_spectrum(rng, 50, 40, [4.0, 2.0, 1.0])
    got, s = lowrank.scaled_left_vectors(entries_of(spark, a), spark.range(40).select("id"), 2, more=4)
    assert np.allclose(s, [4.0, 2.0]) and len(got.first()["v"]) == 2


def test_nothing(spark):
    empty = spark.createDataFrame([], "term string, doc string, weight double")
    assert matrix.svd_embedding(empty, 3).collect() == []


@pytest.mark.parametrize("columns", [5, 40])
def test_zeros_only(spark, columns):
    """Every term in every document: all weights are zero. 40 columns are more than the basis, 5 are not."""
    counts = spark.createDataFrame([(f"t{i}", f"d{j}", 1 + (i + j) % 3) for i in range(6) for j in range(columns)], "term string, doc string, tf bigint")
    weights = matrix.tfidf(counts)
    assert weights.where("weight <> 0").count() == 0
    assert matrix.row_cosine(matrix.svd_embedding(weights, 5)).collect() == []


def test_triangle_of_many_tasks(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(500, 6))
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(values)], lowrank.VECTORS).repartition(70)
    r = lowrank.triangle(vectors, 6)
    assert np.allclose(r.T @ r, values.T @ values)
