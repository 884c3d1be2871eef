"""Matrices, similarity, rules and topics against direct computation."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions.scalars import round2
from tidemark.operators import itemsets, matrix, mining, rules, topics
from tidemark.sources import matrices


def brute_cosine(cells):
    rows = {}
    for t, f, w in cells:
        rows.setdefault(t, {})[f] = w
    out, names = {}, sorted(rows)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            dot = sum(w * rows[b].get(f, 0) for f, w in rows[a].items())
            if dot:
                out[a, b] = dot / math.sqrt(sum(w * w for w in rows[a].values()) * sum(w * w for w in rows[b].values()))
    return out


def test_cosine_with_hot_row_and_hot_feature(spark):
    rng = random.Random(3)
    cells = {("hot", f): 1.0 for f in range(300)}
    cells |= {(f"t{i:02d}", 7): 2.0 for i in range(40)}
    cells |= {(f"t{rng.randrange(40):02d}", rng.randrange(300)): rng.random() for _ in range(200)}
    data = [(t, f, w) for (t, f), w in cells.items()]
    long = spark.createDataFrame(data, "term string, feature int, weight double")
    want = brute_cosine(data)
    for blocks, slices in ((None, None), (1, 1), (5, 3)):
        got = {(r["term_a"], r["term_b"]): r["weight"] for r in matrix.row_cosine(long, blocks, slices).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_cosine_leaves_a_task_in_pieces(spark, monkeypatch):
    """Pairs of a cell are not held at once, sparse or dense, and pairs at or under a number stay in the task."""
    rng = random.Random(5)
    for n_features, per_row in ((6, 6), (400, 3)):
        data = [(f"t{i:02d}", f, rng.uniform(-1, 1)) for i in range(50) for f in rng.sample(range(n_features), per_row)]
        want = brute_cosine(data)
        packed = {}
        for t, f, w in data:
            packed.setdefault(t, []).append((f, w / math.sqrt(sum(x * x for s, _, x in data if s == t))))
        for blocks in (1, 2):
            cell = pa.RecordBatch.from_pylist([
                {"x": 0, "y": blocks - 1, "_block": i % blocks, "term": t, "features": [f for f, _ in r], "weights": [w for _, w in r]}
                for i, (t, r) in enumerate(packed.items())
            ])
            monkeypatch.setattr(matrix, "TILE", 64)
            pieces = list(matrix._cell_pairs(iter([cell]), 0.0))
            assert len(pieces) > 1 and max(p.num_rows for p in pieces) <= 64
            got = {(r["term_a"], r["term_b"]): r["dot"] for p in pieces for r in p.to_pylist()}
            names = sorted(packed)
            met = {(a, b) for a, b in want if blocks == 1 or (names.index(a) + names.index(b)) % 2}
            assert got.keys() == {k for k in met if want[k] > 0} and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    long = spark.createDataFrame(data, "term string, feature int, weight double")
    for blocks, slices in ((2, 1), (2, 3)):
        found = {(r["term_a"], r["term_b"]) for r in matrix.row_cosine(long, blocks, slices, above=0.1).collect()}
        assert found == {k for k, v in want.items() if v > 0.1}


def test_rounding_near_ties(spark):
    rng = random.Random(8)
    values = [rng.uniform(-2, 2) for _ in range(3000)] + [k / 200 + d for k in range(-300, 300) for d in (0, 4e-11, -4e-11, 6e-11, 3e-9, -3e-9, 1e-8, 2e-8)]
    values += [0.0, -0.0, -0.001, float("nan"), float("inf"), 1e15 + 0.25, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows.select(round2(F.col("v")).alias("fast"), F.bround(F.round("v", 10), 2).alias("plain")).collect()
    assert all(repr(r["fast"]) == repr(r["plain"]) for r in got)


def test_tfidf_weighs_documents(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("a", 2)], "term string, doc int")
    got = {(r["term"], r["doc"]): r["weight"] for r in matrix.tfidf(matrix.term_counts(rows)).collect()}
    assert abs(got["a", 1] - 2 * math.log(3 / 3)) < 1e-12
    assert abs(got["a", 2] - math.log(3 / 2)) < 1e-12


def test_svd_keeps_similarity(spark):
    rng = np.random.default_rng(1)
    data = [(f"t{i}", f"d{j}", float(v)) for i in range(6) for j, v in enumerate(rng.random(4))]
    long = spark.createDataFrame(data, "term string, doc string, weight double")
    full = {(r["term_a"], r["term_b"]): r["weight"] for r in matrix.row_cosine(matrix.svd_embedding(long, 100)).collect()}
    want = brute_cosine(data)
    assert all(abs(full[k] - want[k]) < 1e-8 for k in want)
    assert matrix.svd_embedding(long, 2).select("feature").distinct().count() == 2


def test_dense_ids(spark):
    rows = spark.createDataFrame([(w,) for w in ("b", "a", "ab", "abc", "b", "é")], "label string")
    got = {r["label"]: r["id"] for r in matrix.dense_ids(rows, "label").collect()}
    assert got == {"a": 0, "ab": 1, "abc": 2, "b": 3, "é": 4}


def test_symmetric_and_transpose(spark):
    pairs = spark.createDataFrame([("a", "b", 0.5)], "term_a string, term_b string, weight double")
    terms = spark.createDataFrame([("a",), ("b",)], "term string")
    full = {(r["term_a"], r["term_b"]): r["weight"] for r in matrix.symmetric(pairs, terms).collect()}
    assert full == {("a", "b"): 0.5, ("b", "a"): 0.5, ("a", "a"): 1.0, ("b", "b"): 1.0}
    flipped = matrix.transpose(spark.createDataFrame([("t", "d", 1.0)], "term string, doc string, weight double")).first()
    assert (flipped["term"], flipped["doc"]) == ("d", "t")


def test_click_tfidf(spark):
    bags = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["c", "c", "a"])], "doc int, keywords array<string>")
    got = {(r["term"], r["doc"]): r["weight"] for r in matrix.click_tfidf(bags).collect()}
    assert abs(got["b", 1] - math.log(3) / 2) < 1e-12 and got["a", 2] == 0 and abs(got["c", 3] - math.log(3) / 3) < 1e-12


def test_user_terms(spark):
    rows = [(f"u{u}", f"u{u}s{s}", k) for u in range(7) for s in range(6 + (u == 0)) for k in ("x", "y" if u < 5 else "z")]
    rows += [("few", "fs", "x")]
    frame = spark.createDataFrame(rows, "ip string, session_id string, keyword string")
    got = {(r["term"], r["feature"]) for r in mining.user_term_matrix(frame).collect()}
    assert got == {("x", f"u{u}") for u in range(7)}
    weighed = {r["feature"]: r["weight"] for r in mining.user_term_matrix(frame, tfidf=True).collect()}
    assert abs(weighed["u1"] - math.sqrt(6) * (1 + math.log10(3 / 3))) < 1e-12


def test_combinations(spark):
    frame = spark.createDataFrame([("s", k) for k in "cabb"] + [("t", "a"), (None, "a"), ("t", None)], "session_id string, keyword string")
    pick = lambda k: sorted(r["itemset"] for r in itemsets.keyword_combinations(frame, k).where("session_id = 's'").collect())
    assert pick(1) == ["a", "b", "c"] and pick(2) == ["a,b", "a,c", "b,c"] and pick(3) == ["a,b,c"] and pick(4) == []


def test_frequent_sets_against_all_sets(spark, monkeypatch):
    """Sessions of many keywords, one keyword in all of them, one session longer than a block."""
    monkeypatch.setattr(itemsets, "BLOCK", 8)
    rng = random.Random(9)
    bags = {f"s{i}": {"all", *rng.sample([f"k{j:02}" for j in range(14)], rng.randint(0, 6))} for i in range(60)}
    bags["long"] = {f"k{j:02}" for j in range(40)}
    frame = spark.createDataFrame([(s, k) for s, bag in bags.items() for k in bag], "session_id string, keyword string")
    for size, support in ((1, 5), (2, 4), (3, 4), (4, 2), (3, 1)):
        want = Counter(c for bag in bags.values() for c in itertools.combinations(sorted(bag), size))
        got = {tuple(r["items"]): r["sessions"] for r in itemsets.frequent_sets(frame, size, support).collect()}
        assert got == {c: n for c, n in want.items() if n >= support}
    assert itemsets.frequent_sets(frame.where("false"), 2, 1).collect() == []


def test_sets_of_short_sessions_are_counted_from_rows(spark, monkeypatch):
    """Short and long sessions together; with short ones only no list of a set is written."""
    rng, labels, written = random.Random(4), [], itemsets.stage
    monkeypatch.setattr(itemsets, "stage", lambda table, label: (labels.append(label), written(table, label))[1])
    bags = {f"s{i}": set(rng.sample([f"k{j:02}" for j in range(12)], rng.randint(1, 9))) for i in range(80)}
    frame = spark.createDataFrame([(s, k) for s, bag in bags.items() for k in bag], "session_id string, keyword string")
    for row_sets, lists in ((20, True), (4096, False)):
        monkeypatch.setattr(itemsets, "ROW_SETS", row_sets)
        for size, support in ((2, 3), (3, 3), (3, 1)):
            labels.clear()
            want = Counter(c for bag in bags.values() for c in itertools.combinations(sorted(bag), size))
            got = {tuple(r["items"]): r["sessions"] for r in itemsets.frequent_sets(frame, size, support).collect()}
            assert got == {c: n for c, n in want.items() if n >= support}
            assert any(label.startswith("sets-of") for label in labels) is lists


def test_rules_keep_one_direction(spark):
    rows = [("a", "b", 1.0, 0)] * 3 + [("b", "a", 1.0, 0)] + [("a", "c", 1.0, 0)] + [("a", "b", 1.0, 1)]
    out = rules.association_rules(spark.createDataFrame(rows, "query_a string, filter_b string, weight double, type int"))
    got = {(r["query_a"], r["filter_b"], r["type"]): r["confidence"] for r in out.collect()}
    assert got == {("a", "b", 0): 0.75, ("a", "c", 0): 0.25, ("a", "b", 1): 1.0}


def test_labelled_corpus(spark, tmp_path):
    rows = [(1, ["y", "x", "x"], "one two_b"), (2, [], "three"), (3, ["y"], "one")]
    frame = spark.createDataFrame(rows, "short_name int, labels array<string>, tokens string")
    corpus = topics.labelled_corpus(frame)
    matrices.write_corpus(corpus, str(tmp_path / "c"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "c")).collect())
    assert lines == ["[0 1]\tone two_b", "[1]\tone", "[]\tthree"]
    assert [(r["word"], r["n"]) for r in topics.word_counts(frame).collect()] == [("one", 2), ("three", 1)]


def test_matrix_files(spark, tmp_path):
    long = spark.createDataFrame([("a", "f0", 1.0), ("b", "f1", 2.5)], "term string, feature string, weight double")
    matrices.write_matrix(long, ["f0", "f1"], str(tmp_path / "m"))
    got = {(r["term"], r["feature"]): r["weight"] for r in matrices.read_matrix(spark, str(tmp_path / "m")).collect()}
    assert got == {("a", 0): 1.0, ("b", 1): 2.5}
    (tmp_path / "two.csv").write_text(" Num,d1,d2\n Num,f0,f1\nsea ice,0,3\nzero,0,0\n")
    assert [(r["term"], r["feature"], r["weight"]) for r in matrices.read_matrix(spark, str(tmp_path / "two.csv"), 2).collect()] == [("sea ice", 1, 3.0)]
    (tmp_path / "gap.csv").write_text("t,1,,3,\n")
    assert [(r["feature"], r["weight"]) for r in matrices.read_matrix(spark, str(tmp_path / "gap.csv")).collect()] == [(0, 1.0), (2, 3.0)]


LONG = "term string, feature string, weight double"


def test_matrix_file_of_many_columns(spark, tmp_path):
    """100,000 columns, rows of three cells, of none of the named columns, and of every column; read back whole."""
    n = 100_000
    features = spark.range(n).select(F.format_string("d%06d", "id").alias("feature"))
    some = [("a", "d000000", 1.0), ("a", "d050000", 2.0), ("a", "d050000", 0.5), ("a", f"d{n - 1:06d}", -3.0), ("b", "other", 4.0), ("b", "d000001", None), (None, "d000001", 1.0), ("a", None, 1.0)]
    long = spark.createDataFrame(some, LONG).union(features.select(F.lit("full"), "feature", F.lit(1.0)))
    matrices.write_matrix_file(long, str(tmp_path / "wide"), features)
    lines = [line for part in sorted((tmp_path / "wide").glob("part-*")) for line in part.read_text().splitlines()]
    assert [line[:14] for line in lines] == ["Num,d000000,d0", "Num,f0,f1,f2,f", "a,1.0,0.0,0.0,", "b,0.0,0.0,0.0,", "full,1.0,1.0,1"]
    assert {line.count(",") for line in lines} == {n}
    got = matrices.read_matrix(spark, str(tmp_path / "wide"), 2)
    assert sorted((r["feature"], r["weight"]) for r in got.where("term = 'a'").collect()) == [(0, 1.0), (50_000, 2.5), (n - 1, -3.0)]
    assert got.where("term = 'b'").count() == 0 and got.where("term = 'full'").count() == n


def test_matrix_file_of_odd_rows(spark):
    assert matrices.matrix_file_lines(spark.createDataFrame([], LONG)).count() == 0
    odd = spark.createDataFrame([("x, y", "p,q", 1.0), ("", "z\n", 2.0), ("x, y", "z\n", 1e20)], LONG)
    assert sorted(r["line"] for r in matrices.matrix_file_lines(odd).collect()) == [",0.0,2.0", "Num,f0,f1", "Num,p q,z ", "x  y,1.0,1.0E20"]


def test_matrix_lines_are_dealt_by_the_cells_of_the_file(spark, monkeypatch):
    monkeypatch.setattr(matrices, "TASK_CELLS", 400)
    features = spark.range(100).select(F.format_string("d%03d", "id").alias("feature"))
    long = spark.range(200).select(F.format_string("t%03d", "id").alias("term"), F.format_string("d%03d", F.col("id") % 100).alias("feature"), F.lit(1.0).alias("weight"))
    lines = matrices.matrix_file_lines(long, features).where("section = 2").select("line", F.spark_partition_id().alias("task")).collect()
    assert len(lines) == 200 and {r["line"].count(",") for r in lines} == {100}
    assert max(Counter(r["task"] for r in lines).values()) <= 16


def test_asked_rows_meet_all_rows(spark):
    rng = random.Random(3)
    data = [(f"t{i}", f"d{j}", float(rng.randint(1, 5))) for i in range(12) for j in range(6) if rng.random() < 0.5]
    long = spark.createDataFrame(data, "term string, feature string, weight double")
    asked = spark.createDataFrame([("t1",), ("t5",), ("none",)], "term string")
    got = {(r["term_a"], r["term_b"]): r["weight"] for r in matrix.cosine_with(long, asked).collect()}
    want = {k: v for k, v in brute_cosine(data).items() if {"t1", "t5"} & set(k) and v}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_triples_and_clicks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Ocean Tide,SubClassOf,Tides\nWave,EquivalentClass,Swell\n")
    got = {(r["concept_a"], r["concept_b"]): r["weight"] for r in matrices.read_triples(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {("tide", "ocean tide"): 0.75, ("swell", "wave"): 0.9}
    (tmp_path / "c.json").write_text('{"query":"a,b","viewdataset":"d","downloaddataset":"","sessionId":"s","type":"t"}\n')
    assert [(r["keyword"], r["dataset"], r["downloaded"]) for r in matrices.read_clicks(spark, str(tmp_path / "c.json")).collect()] == [("a", "d", False), ("b", "d", False)]


def test_rule_file(spark, tmp_path):
    rows = [("a", "f", 3.0, 0.125, 2.0, 0), ("a", "g", 3.0, 0.5, 0.5, 0), ("a", "h", 3.0, 0.5, 2.0, 1)]
    frame = spark.createDataFrame(rows, "query_a string, filter_b string, support_a double, confidence double, count double, type int")
    matrices.write_rules(frame, 0, str(tmp_path / "r"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "r")).collect()] == [("a", "f", "3.0", "0.12", "2.0")]


def test_asked_rows_are_sent_and_the_matrix_is_not_shuffled(spark, monkeypatch):
    """The cells meet the asked rows where they are, in one round or several; rows and features without a name are no match."""
    rng = random.Random(9)
    data = [(f"t{i:02}", f"f{j}", float(rng.randint(1, 5))) for i in range(40) for j in rng.sample(range(15), 4)]
    odd = [(None, "f1", 3.0), ("t05", None, 2.0), ("zero", "f1", 0.0)]
    table = spark.createDataFrame(data + odd, "term string, feature string, weight double")
    asked = spark.createDataFrame([("t05",), ("t07",), ("t07",), ("zero",), ("other",), (None,)], "term string")
    whole = brute_cosine([*data, ("t05", "none", 2.0)])
    want = {k: w for k, w in whole.items() if {"t05", "t07"} & set(k)}
    for most in (2_000_000, 3):
        monkeypatch.setattr(matrix, "ASKED_ENTRIES", most)
        rows = matrix.cosine_with(table, asked)
        got = {(r["term_a"], r["term_b"]): r["weight"] for r in rows.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    monkeypatch.setattr(matrix, "ASKED_ENTRIES", 2_000_000)
    plan = matrix.cosine_with(table, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan or "leftHint=(strategy=broadcast)" in plan
