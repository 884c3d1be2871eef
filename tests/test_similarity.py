"""The threshold join of rows against all pairs worked out one by one."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tidemark.operators import matrix, similarity
from tidemark.plans import inputs as src
from tidemark.plans import queries
from tidemark.session import stage

SCHEMA = "term string, feature string, weight double"


def brute(data, threshold):
    """{(a, b): cosine} of all similar pairs of rows, copies expanded."""
    rows = defaultdict(dict)
    for term, feature, weight in data:
        if term is not None and feature is not None and weight:
            rows[term][feature] = weight
    norms = {t: math.sqrt(sum(w * w for w in r.values())) for t, r in rows.items()}
    names, out = sorted(rows), {}
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            dot = sum(w * rows[b].get(f, 0.0) for f, w in rows[a].items()) / norms[a] / norms[b]
            if round(dot, 9) >= threshold:
                out[a, b] = dot
    return out


def expanded(rows):
    """All similar pairs that the result stands for."""
    members = defaultdict(list)
    for r in rows:
        if r["same"]:
            members[r["term_a"]].append(r["term_b"])
    out = {}
    for first, others in members.items():
        everyone = sorted([first, *others])
        out |= {(a, b): 1.0 for i, a in enumerate(everyone) for b in everyone[i + 1:]}
    for r in rows:
        if not r["same"]:
            for a in [r["term_a"], *members[r["term_a"]]]:
                for b in [r["term_b"], *members[r["term_b"]]]:
                    out[min(a, b), max(a, b)] = r["weight"]
    return out


def crowded(rng):
    """Copies, near copies, a row in every feature, a feature in every row, signed weights."""
    data = []
    for i in range(60):
        row = {f"f{rng.randint(0, 25)}": float(rng.randint(1, 6)) for _ in range(rng.randint(1, 6))}
        data += [(f"a{i:03}", f, w) for f, w in row.items()]
        data += [(f"b{i:03}", f, 2.5 * w) for f, w in row.items()]  # the same direction
        data += [(f"c{i:03}", f, w + rng.choice([0.0, 0.7])) for f, w in row.items()]
    data += [(f"d{i:03}", "f3", float(i + 1)) for i in range(40)]
    data += [("hot", f"f{j}", 1.0 + j % 3) for j in range(26)] + [("hot2", f"f{j}", 1.1 + j % 3) for j in range(26)]
    data += [(f"s{i:03}", f"g{j}", rng.uniform(-1, 1)) for i in range(30) for j in range(40)]
    data += [(f"t{i:03}", f"g{j}", w + rng.uniform(-0.2, 0.2)) for i in range(30) for j, w in enumerate([x[2] for x in data if x[0] == f"s{i:03}"])]
    return data


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.97, 1.0])
def test_similar_rows(spark, threshold):
    data = crowded(random.Random(11))
    got = expanded(similarity.similar_rows(spark.createDataFrame(data, SCHEMA).repartition(5), threshold).collect())
    want = brute(data, threshold)
    assert set(got) == set(want) and want
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_copies_are_not_expanded(spark):
    data = [(f"t{i:04}", "f", float(i % 9 + 1)) for i in range(3000)] + [("u", "f", 1.0), ("u", "g", 0.1)]
    rows = similarity.similar_rows(spark.createDataFrame(data, SCHEMA), 0.8).collect()
    assert len(rows) == 2999 + 1 and {r["term_a"] for r in rows} == {"t0000"}


def test_bounds_leave_few_pairs(spark):
    """2000 rows share a frequent feature; only the near ones are multiplied out."""
    rng = random.Random(2)
    data = [(f"t{i:04}", "everywhere", 1.0) for i in range(2000)]
    data += [(f"t{i:04}", f"r{i // 2}x{j}", rng.uniform(1, 2)) for i in range(2000) for j in range(3)]
    unit = matrix.normalised_rows(spark.createDataFrame(data, SCHEMA))
    entries = unit.selectExpr("cast(substring(term, 2) as bigint) as id", "feature", "weight")
    pairs = similarity.candidate_pairs(similarity.prefix_entries(entries, 0.8), 0.8)
    assert pairs.count() == 1000


def test_oddities(spark):
    data = [(None, "f", 1.0), ("a", None, 1.0), ("zero", "f", 0.0), ("b", "f", 2.0), ("", "f", 1.0), ("null", "f", None)]
    rows = similarity.similar_rows(spark.createDataFrame(data, SCHEMA), 0.9).collect()
    assert [tuple(r) for r in rows] == [("", "b", 1.0, True)]
    assert similarity.similar_rows(spark.createDataFrame([], SCHEMA), 0.9).collect() == []
    with pytest.raises(ValueError):
        similarity.similar_rows(spark.createDataFrame([], SCHEMA), 0.0)


def brute_links(data):
    """{row: (links, hundredths)}: all positive cosines, copies expanded."""
    pairs = {k: v for k, v in brute(data, -1.0).items() if v > 1e-12}
    out = {t: [0, 0] for t, f, w in data if t is not None and f is not None and w}
    for (a, b), cosine in pairs.items():
        for t in (a, b):
            out[t][0] += 1
            out[t][1] += round(round(cosine, 10) * 100)
    return out


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 40, "block_entries": 200}])
def test_linked_rows(spark, monkeypatch, blocks):
    """No positive cosine is lost, in one block or in many, however small the pieces are."""
    if blocks:
        monkeypatch.setattr(similarity, "row_links", lambda rows: matrix.row_links(rows, **blocks))
    data = crowded(random.Random(11)) + [("alone", "z", 1.0), (None, "f1", 1.0), ("zero", "f1", 0.0)]
    got = {r["term"]: (r["links"], r["hundredths"], r["first"]) for r in similarity.linked_rows(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()}
    want = brute_links(data)
    assert got.keys() == want.keys() and got["alone"] == (0, 0, "alone") and got["d007"][2] == "d000"
    assert all(got[t][0] == n and abs(got[t][1] - h) <= 1 for t, (n, h) in want.items())


def test_document_term_cosine_takes_the_whole_vocabulary(spark, tmp_path):
    docs = [(i, f"common{'x' * (i % 2)} word{chr(97 + i)} " + " ".join(f"rare{chr(97 + i)}{chr(97 + j)}" for j in range(25))) for i in range(12)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    weights = matrix.tfidf(src.document_counts(spark, str(tmp_path))).select("term", "doc", "weight").collect()
    want = brute_links([tuple(r) for r in weights])
    got = {r["term"]: (r["links"], r["hundredths"]) for r in queries.document_term_cosine(spark, str(tmp_path)).collect()}
    assert got == {t: tuple(v) for t, v in want.items()}
    assert len(want) > 250  # nearly all have one document; stems may fall together


def _parts_of_seven_brands(spark, folder):
    parts = [(i, f"Brand#{11 + 10 * (i % 7)}") for i in range(700)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string").write.parquet(f"{folder}/part.parquet")
    return parts


def test_svd_group_names_copies_once(spark, tmp_path):
    """A row a part, not a pair of parts: 7 brands, the 5 of largest norm stay."""
    parts = _parts_of_seven_brands(spark, tmp_path)
    rows = src.table(spark, str(tmp_path), "part").selectExpr("p_partkey as term", "p_brand as doc", "double(substring(p_brand, 7, 2)) as weight")
    linked = similarity.linked_rows(matrix.svd_embedding(rows, 5), matrix.ZERO)
    got = {r["term"]: (r["first"], r["links"], r["hundredths"]) for r in linked.collect()}
    firsts = {g: min(str(i) for i, _ in parts if i % 7 == g) for g in range(7)}
    assert got == {str(i): (firsts[i % 7], 99, 9900) for i, _ in parts if i % 7 >= 2}


def test_svd_group_cosine_has_every_pair(spark, tmp_path):
    """Each of the 5 brands of largest norm has all its pairs of parts, whatever copies they are."""
    parts = _parts_of_seven_brands(spark, tmp_path)
    got = sorted(tuple(r) for r in queries.svd_group_cosine(spark, str(tmp_path)).collect())
    names = {g: sorted(str(i) for i, _ in parts if i % 7 == g) for g in range(2, 7)}
    assert got == sorted((a, b, 1.0) for each in names.values() for i, a in enumerate(each) for b in each[i + 1:])
    assert len(got) == 5 * 100 * 99 // 2


def test_noise_is_no_link(spark):
    data = [("a", "x", 1.0), ("b", "y", 1.0), ("b", "x", 1e-12), ("c", "y", 1.0), ("c", "z", 1.0)]
    got = {r["term"]: (r["links"], r["hundredths"]) for r in similarity.linked_rows(spark.createDataFrame(data, SCHEMA), 1e-9).collect()}
    assert got == {"a": (0, 0), "b": (1, 71), "c": (1, 71)}


def test_tasks_of_registered_queries_are_bounded(spark):
    """The text hashes of two million rows are no eight large tasks: a task reads some 8 MB, however many rows there are."""
    queries.REGISTRY["keyword_suggestions"](spark, "/root/testdata/sf0.001")
    rows = spark.range(2_000_000).select(F.sha2(F.col("id").cast("string"), 256).alias("x")).distinct()
    assert rows.rdd.getNumPartitions() >= 12


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7])
def test_blocks_meet_once_and_are_not_shuffled(spark, n):
    packed = spark.createDataFrame([(i, bytes([i])) for i in range(n)], "block int, data binary")
    met = matrix.met_rows(packed, n)
    assert sorted((min(r["x"], r["y"]), max(r["x"], r["y"])) for r in met.collect()) == [(i, j) for i in range(n) for j in range(i, n)]
    assert all(r["held"]["data"][0] == r["x"] and r["passing"]["data"][0] == r["y"] for r in met.collect())
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()


def test_cosine_of_many_blocks_shuffles_no_row_twice(spark):
    """Blocks meet without a shuffle; rows without a feature, of zeros, of nothing, and without a term."""
    rng = random.Random(4)
    data = [(f"t{i:03}", f"f{j}", rng.uniform(-1, 1)) for i in range(90) for j in rng.sample(range(30), 4)]
    odd = [("t003", None, 2.0), (None, "f1", 1.0), ("zero", "f1", 0.0), ("none", "f1", None), ("bare", None, 1.0)]
    rows = matrix.row_cosine(spark.createDataFrame(data + odd, SCHEMA), blocks=9, slices=1, above=0.0)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    norm = math.sqrt(1 + 4 / sum(w * w for t, _, w in data if t == "t003"))
    want = {k: w / (norm if "t003" in k else 1) for k, w in brute(data, -1.0).items() if w > 1e-12}
    got = {(r["term_a"], r["term_b"]): r["weight"] for r in rows.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("tile", [64, 1 << 20])
def test_hits_of_blocks(monkeypatch, tile):
    """Rows with few and with many products, a feature only one block has, pieces of any size."""
    monkeypatch.setattr(matrix, "TILE", tile)
    rng = np.random.default_rng(1)
    sides = []
    for shift in (0, 5):
        dense = rng.uniform(-1, 1, (50, 200)) * (rng.uniform(size=(50, 200)) < 0.004)
        dense[:3, 10:60] = 0.5
        row, code = np.nonzero(dense)
        names = pa.array([f"r{i}" for i in range(50)])
        sides.append((dense, matrix._Block(names, np.bincount(row, minlength=50), pa.array(np.arange(200) + shift), code, dense[row, code])))
    (a, left), (b, right) = sides
    want = a[:, 5:] @ b[:, :-5].T
    got = {}
    for i, j, dots in matrix._hits(left, right, 0.0):
        assert len(i) <= max(tile, 50)
        got |= dict(zip(zip(i.tolist(), j.tolist(), strict=True), dots, strict=True))
    assert got.keys() == {(int(i), int(j)) for i, j in zip(*np.nonzero(want > 0), strict=True)}
    assert all(abs(want[k] - v) < 1e-12 for k, v in got.items())


def test_linked_rows_in_rounds(spark, monkeypatch):
    """A matrix of many blocks is dealt in rounds; links are the same."""
    monkeypatch.setattr(matrix, "ROUND_CELLS", 300)
    monkeypatch.setattr(matrix, "STREAMS", 2)
    monkeypatch.setattr(similarity, "row_links", lambda rows: matrix.row_links(rows, block_rows=25))
    data = crowded(random.Random(8))
    got = {r["term"]: (r["links"], r["hundredths"]) for r in similarity.linked_rows(spark.createDataFrame(data, SCHEMA)).collect()}
    want = brute_links(data)
    assert got.keys() == want.keys() and all(got[t][0] == n and abs(got[t][1] - h) <= 1 for t, (n, h) in want.items())


def _shuffle_files(spark):
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


def test_a_written_table_leaves_no_shuffle(spark):
    table = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = _shuffle_files(spark)
    assert stage(table, "counts").count() == 7
    assert {r["count"] for r in table.collect()} == {142, 143}  # what was written can be worked out again
    assert stage(table.join(table.withColumnRenamed("count", "n"), "k"), "pairs").count() == 7
    left = {f.split("_")[1] for f in _shuffle_files(spark) - before}
    assert len(left) <= 3  # of what was counted and collected, not of what was written
