"""The fingerprint that rules pairs out, against the Jaccard similarity of their whole sets."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import near_duplicates as near
from tidemark.llm import simhash
from tidemark.session import stage, stage_result


def pair(draw, words, edits):
    """Two texts, the second with its last words changed; and the similarity of their sets of five-word shingles."""
    first = [f"w{draw.randrange(10 ** 9)}" for _ in range(words)]
    second = first[:words - edits] + [f"x{draw.randrange(10 ** 9)}" for _ in range(edits)]
    sets = [{" ".join(t[i:i + 5]) for i in range(len(t) - 4)} for t in (first, second)]
    return " ".join(first), " ".join(second), len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_no_pair_of_the_similarity_is_ruled_out():
    draw, far, tried = random.Random(5), near.far_bits(0.8), 0
    for words in (13, 14, 20, 21, 32, 60, 133, 400):  # 9 shingles are the fewest of which one may change
        texts, wanted = [], []
        for _ in range(150):
            edits = max(1, round((words - 4) / 9) - draw.randrange(2))
            a, b, similarity = pair(draw, words, edits)
            texts += [a.encode(), b.encode()]
            wanted.append(similarity >= 0.8)
        _, n, prints, _ = near.sketches_of(texts, 5)
        bits = np.bitwise_count((prints[0::2] ^ prints[1::2]).view(np.uint64)).sum(1, dtype=np.int64)
        assert (n == words - 4).all() and prints.shape[1] == near.WORDS
        assert (bits[np.array(wanted)] <= far).all()
        tried += sum(wanted)
    assert tried > 500


def test_unlike_texts_are_ruled_out():
    draw = random.Random(6)
    texts = [t.encode() for _ in range(200) for t in pair(draw, 60, 60)[:2]]
    prints = near.sketches_of(texts, 5)[2]
    bits = np.bitwise_count((prints[0::2] ^ prints[1::2]).view(np.uint64)).sum(1, dtype=np.int64)
    assert (bits > near.far_bits(0.8)).mean() > 0.99


def test_columns_named_like_the_stage_s_own(spark):
    rows = [(1, "a b c d e f g", "x", "m", "k", 7, 0), (2, "a b c d e f g", "y", "m", "k", 8, 0), (3, "p q r s t u v", None, "n", "l", 9, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _row string, _mark string, _kept string, _Kept_Mark int, _end int")
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]


def test_near_texts_meet_by_simhash(spark):
    """With no smallest shingle in common, near texts still meet by their fingerprints, and only near ones are linked."""
    draw = random.Random(8)
    words = [f"w{draw.randrange(10 ** 9)}" for _ in range(900)]
    rows = [(i, " ".join(words[:450] + [f"new{i}"] + words[450:])) for i in range(4)]
    rows += [(9 + i, "a b c d e f g " * 60 + " ".join(f"w{draw.randrange(10 ** 9)}" for _ in range(8))) for i in range(2)]  # one SimHash, unlike sets
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sketched = near.stage(near.sketches(docs, 5), "test-sketches")
    kinds = sketched.groupBy("node").agg(F.min("doc_id").alias("low"), *(F.first(c).alias(c) for c in ("n", "print", "lows")))
    apart = kinds.withColumn("lows", F.transform("lows", lambda x, i: F.xxhash64("node", i)))
    met = {r["low"]: (r["node"], r["lows"]) for r in near.met_by_simhash(sketched, apart).collect()}
    same = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(docs).collect()}
    assert {a for a in met for b in met if a < b and met[a][1][0] == met[b][1][0]} == {a for a in same for b in same if a < b and same[a] == same[b]}
    assert same[10] == 9 and len(set(same.values())) < 4
    links = {(r["a"], r["b"]) for r in near.near_links(docs, near.met_by_simhash(sketched, apart), 5, 0.8).collect()}
    ids = {node: low for low, (node, _) in met.items()}
    joined = {frozenset((ids[a], ids[b])) for a, b in links}
    assert joined and all(max(pair) < 9 for pair in joined)
    groups = {r["doc_id"]: r["component_id"] for r in near.near_groups(docs).collect()}
    assert groups == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9, 10: 10}


def test_what_a_cell_joins_is_a_star():
    own, group = np.array([0, 0, 1, 2, 3, 3]), np.array([2, 2, 2, 2, 3, 3])
    a, b = near.star(own, group, np.array([7, 5, 9, 2, 1, 8]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(2, 5), (2, 9)]


def test_tables_on_the_way_go_when_the_result_is_written(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{base} x{i % 3}" if i < 6 else f"only {i} of a kind") for i in range(9)]
    context, before = spark.sparkContext, spark.sparkContext.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    try:
        kept = near.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
        folder = Path(context.getCheckpointDir().removeprefix("file:"))
        assert {p.name.rsplit("-", 1)[0] for p in folder.iterdir()} == {"best"}
        assert sorted(r.doc_id for r in kept.collect()) == [0, 6, 7, 8]
    finally:
        context.setCheckpointDir(str(tmp_path / "rest") if before is None else before)


def test_a_failed_result_deletes_nothing_and_ends_the_record(spark):
    made = []

    def broken():
        made.append(stage(spark.range(3).toDF("x"), "part"))
        raise ValueError("no result")

    with pytest.raises(ValueError, match="no result"):
        stage_result(spark, broken, "never")
    assert made[0].count() == 3
    outer = stage(spark.range(2).toDF("x"), "outer")
    assert stage_result(spark, lambda: outer.join(stage(outer, "inner"), "x"), "joined").count() == 2
    assert outer.count() == 2
