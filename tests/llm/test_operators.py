"""The training-data operators against plain models, on given tables and on rows with every oddity."""

import hashlib
import json
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import (
    chat, embedding_dedup, licenses, mixing, near_duplicates, packing, pii, quality, sharding, simhash, topk,
)

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, fp int, label string, size int, node int"
LONG = "word " * 60_000
ODD = [
    (1, "", "en", "a"), (2, None, "en", "a"), (None, "A tail of one", None, None), (3, " \t\n ", "fr", "b"),
    (4, "Same text here, twice over.", "en", "b"), (4, "Same text here, twice over.", "en", "b"), (5, "same TEXT here, twice over.", "en", "c"),
    (6, LONG, "en", "a"), (7, "x@y.example +1 (212) 555-0100 4539 1488 0343 6467 1.2.3.4 999.1.1.1", "de", "c"),
    (8, "under the MIT license; Apache License, Version 2.0; CC-BY-NC 4.0", None, "d"), (9, "été \U0001F600 ünder", "xx", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3, 4) for r in ODD], DOC)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module", params=["given", "odd", "empty"])
def table(request, docs, odd):
    return {"given": docs, "odd": odd, "empty": odd.where("false")}[request.param]


def pairs(table):
    return [tuple(r) for r in table.select("doc_id", "text").collect()]


def test_simhash(table):
    rows = pairs(table)
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(table).collect())
    assert got == Counter((d, *w) for (d, _), w in zip(rows, brute.simhash_components(rows), strict=True))


def test_near_groups(spark, docs):
    rows = [r for r in pairs(docs) if r[0] is not None]
    words = [f"w{i}" for i in range(400)]
    near = [(10**6 + i, " ".join(words[:5 * i] + [f"new{i}"] + words[5 * i + 1:])) for i in range(60)]
    far = [(2 * 10**6 + i, " ".join(words[:150] + [f"own{i}w{j}" for j in range(150)])) for i in range(60)]
    table = docs.where("doc_id IS NOT NULL").select("doc_id", "text").union(spark.createDataFrame(near + far, "doc_id bigint, text string"))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_groups(table).collect()}
    assert got == brute.near_components(rows + near + far)


def test_near_groups_star_of_copies(spark):
    """Copies at 0.82 to their original and 0.69 to one another: only the links to the original join them."""
    words = [f"w{i}" for i in range(604)]
    rows = [(0, " ".join(words))]
    for i in range(1, 2001):
        text = list(words)
        for j in range(12):
            text[10 + 49 * j + (i * (j + 3) + i // 40) % 40] = f"copy{i}x{j}"
        rows.append((i, " ".join(text)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    assert {r["component_id"] for r in near_duplicates.near_groups(table).collect()} == {0}


def test_near_groups_in_a_crowd_with_one_passage(spark):
    """Pairs at 0.98 among 1500 texts that all share three quarters of their shingles."""
    passage = [f"w{i}" for i in range(304)]
    rows = []
    for i in range(1500):
        own = [f"own{i // 2}x{j}" for j in range(100)]
        rows.append((i, " ".join(passage + own[:-4] + ([f"last{i}"] if i % 2 else own[-4:]))))
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates.near_groups(table).collect()} == {i: i // 2 * 2 for i in range(1500)}


@pytest.mark.parametrize(("block_nodes", "block_shingles"), [(3, 1 << 20), (1024, 500)])
def test_near_links_in_small_blocks(spark, block_nodes, block_shingles):
    rows = [(i, " ".join(f"w{j}" if j != 7 * i else f"new{i}" for j in range(200 + 400 * (i % 2)))) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    kinds = near_duplicates.sketches(table, 5).groupBy("node").agg(
        F.min("doc_id").alias("low"), *(F.first(c).alias(c) for c in ("n", "print", "lows")))
    low = {r["node"]: r["low"] for r in kinds.collect()}
    groups, want = brute.Union(), brute.near_components(rows)
    for r in near_duplicates.near_links(table, kinds, 5, 0.8, block_nodes, block_shingles).collect():
        groups.join(low[r["a"]], low[r["b"]])
    assert {i: groups.root(i) for i in low.values()} == {i: want[i] for i in low.values()}


def test_keep_one(odd):
    kept = near_duplicates.keep_one(odd, size=3)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 4), (False, 6), (False, 7), (False, 8), (False, 9), (True, 0)]


def test_keep_one_goes_by_rows_not_ids(spark):
    word = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(None, word(f"null{i}"), "a") for i in range(50)] + [(None, word("null0"), "b"), (None, word("first"), "a")]
    rows += [(1, word("first"), "a"), (2, word("second"), "a"), (2, word("third"), "a"), (3, word("third"), "a"), (3, word("third"), "a")]
    kept = near_duplicates.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert Counter(r["text"] for r in kept) == Counter({r[1] for r in rows})
    assert {(r["doc_id"], r["text"]) for r in kept if r["doc_id"]} == {(1, word("first")), (2, word("second")), (2, word("third"))}


def test_mixing(table):
    rows = [tuple(r) for r in table.select("doc_id", "text", "source").collect()]
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split()) if text else 0
    got = mixing.mixed(table).collect()
    assert len(got) == len(rows)
    if not rows:
        return
    targets = brute.targets(dict(sizes))
    by_size = {(s, n): targets[k] for k, n in sizes.items() for s in [n]}
    for r in got:
        assert r["target"] == pytest.approx(by_size[r["source_size"], r["source_size"]]) or list(sizes.values()).count(r["source_size"]) > 1
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    again = mixing.mixed(table).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)


def test_mixing_meets_targets(docs):
    got = mixing.mixed(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= r["most"] for r in got)


def test_packing(table):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.packed_sequences(table, public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = Counter((d, p, *x) for d, t in pairs(table) for p, x in enumerate(brute.token_pieces(tokenizer, t)))
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_local_search_empties_bins():
    bins = packing.Bins([6, 6, 4, 4, 3, 3, 2, 2], 10)
    bins.items, bins.fill = {0: [0, 6], 1: [1, 7], 2: [2, 4], 3: [3, 5]}, {0: 8, 1: 8, 2: 7, 3: 7}
    bins.local_search(1000)
    assert len(bins.items) == 3 and sorted(i for items in bins.items.values() for i in items) == list(range(8))
    sizes = np.random.default_rng(1).integers(1, 900, 4000).tolist()
    assert len(packing.pack_group(sizes, 2048)) <= -(-sum(sizes) // 2048) + 1


def test_shards(table):
    rows = pairs(table)
    got = sharding.document_shards(table, 5).collect()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(5)]
    assert max(counts) - min(counts) <= 1


def test_shards_move_little(docs):
    keys = docs.select("doc_id")
    few, more = ({r["doc_id"]: r["shard"] for r in sharding.bounded_ring_shards(keys, ["doc_id"], n, 0.25).collect()} for n in (10, 11))
    assert sum(few[k] != more[k] for k in few) < 0.4 * len(few)
    assert max(Counter(few.values()).values()) <= int(1.25 * len(few) / 10) + 1


def test_licenses(table):
    got = Counter(tuple(r)[:6] for r in licenses.license_scan(table).collect())
    assert got == Counter((d, *brute.license_base(t)) for d, t in pairs(table))


def test_license_diagonals(spark):
    text = "intro words Permission is hereby granted, free of charge, to any person obtaining a NEW copy of this software and associated documentation files, to deal in the Software without restriction"
    row = licenses.license_scan(spark.createDataFrame([(1, text), (2, "permission is hereby granted to nobody at all")], "doc_id int, text string")).orderBy("doc_id").collect()
    assert row[0]["labels"] == "mit" and row[0]["n_base"] == 0 and 0.6 <= row[0]["score"] < 1
    assert row[1]["labels"] == "" and row[1]["score"] == 0


def test_personal_data(table):
    got = pii.find_personal_data(table).collect()
    want = Counter()
    for d, t in pairs(table):
        base = brute.personal_data(t)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        want[d, *[sum(s[0] == k for s in base) for k in pii.BASE], digest] += 1
    assert Counter(tuple(r)[:6] for r in got) == want


@pytest.mark.parametrize("text", [
    "a@b@c.d a@b..c @x.y a.@b.c.d. é@x.com", "1.2.3.4.5.6.7.8 1.2.3 0001.2.3.4 256.1.1.1", "4" * 5000, "1." * 5000, "+" * 3000 + "1 2",
    "+1 2 3 4 5 6 7 8-", "4539-1488-0343-6467 4539 1488  0343 6467", "a" * 5000 + "@", "+1" + " " * 50 + "2345678",
])
def test_base_patterns(text):
    assert pii.base_spans(text) == brute.personal_data(text)


def test_field_learns_shapes():
    texts = [f"call +1 ({a}) 555-{b:04d} now" for a, b in zip(range(200, 260), range(1000, 1060), strict=True)]
    texts += [f"the year {n} and {n % 7} items" for n in range(1900, 1960)]
    field = pii.SemiMarkov().train([e for t in texts for e in pii.variants(t, pii.weak_spans(t))])
    found = pii.spans_of("please ring (312) 555-0199 today, in 1987", field)[1]
    assert found == [("phone", 12, 26)]
    assert pii.mask("ring (312) 555-0199", [("phone", 5, 19)]) == "ring [phone]"


def test_masked_keeps_columns(odd):
    out = pii.masked(odd, length_column="n_chars")
    assert out.columns == odd.columns and out.count() == len(ODD)
    row = out.where("doc_id = 7").first()
    assert "x@y.example" not in row["text"] and "[email]" in row["text"] and row["n_chars"] == len(row["text"])
    assert out.where("doc_id = 2").first()["text"] is None


def test_quality_model(spark):
    texts = ["the cat sat on the mat.", "the dog sat on the log.", "a cat and a dog", "that 12 cats, 3 mats"]
    model = quality.train(spark.createDataFrame([("0/en", t) for t in texts], "lang string, text string"), 3)
    tests = ["the cat sat", "zzz", "", "dog 77"]
    rows = spark.createDataFrame([(i, "0/en", t) for i, t in enumerate(tests)], "row bigint, lang string, text string")
    for grams in (1 << 20, 40):
        got = {r["row"]: (r["logprob"], r["n"]) for r in quality.score(rows, model, 3, grams).collect()}
        table = quality.symbols()
        p = brute.kneser_ney(texts, 3, table, quality.BEGIN, quality.END, 2.0**-8)
        for i, t in enumerate(tests):
            s = [quality.BEGIN] * 2 + [int(table[ord(c)]) for c in t] + [quality.END]
            want = sum(np.log(p(tuple(s[j - 2:j + 1]))) for j in range(2, len(s)))
            assert got[i][0] == pytest.approx(want) and got[i][1] == len(t) + 1


def test_quality_judges(table):
    trusted = table.where("doc_id % 2 = 0").select("doc_id")
    got = quality.judged(table, trusted).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in pairs(table))
    texts = dict(pairs(table))
    assert all(r["kept"] for r in got if not texts[r["doc_id"]])


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.where("pmod(xxhash64(doc_id), 4) > 0 and quality = 1 and toxic = 0").select("doc_id")
    held = labels.where("pmod(xxhash64(doc_id), 4) = 0")
    got = quality.judged(spark.read.parquet(f"{sf}/documents.parquet"), seen).join(held, "doc_id").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert np.mean(good) >= 0.9 and np.mean(bad) <= 0.4


VECTORS = [
    (0, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.01, 0.0], 1), (3, [1.0, 0.0, 0.0], 2), (4, None, 1),
    (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 0.0], 1), (7, [float("nan"), 1.0, 0.0], 1), (8, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], None),
    (10, [], 1), (11, [1e200, 0.0, 0.0], 1), (12, [-1.0, 0.0, 0.0], 1), (100, [0.5, 0.5, 0.1], 1), (200, [1.0, 0.0], 1),
]


@pytest.mark.parametrize("rows", [VECTORS, []])
def test_embedding_oddities(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, node string, weight int")
    got = Counter(tuple(r) for r in embedding_dedup.near_duplicate_vectors(table, block=2, parts=2).collect())
    line = {0: (4, 0), 1: (4, 0), 2: (4, 0), 11: (4, 0), 8: (1, 8), 200: (1, 8)}
    assert got == Counter((i, *line.get(i, (0, i)), line.get(i, (0, i))[1] == i) for i, _, _ in rows)


def test_embedding_blocks(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12))
    vectors = [(i, (centres[i % 30] + rng.normal(size=12) * rng.choice([0.02, 0.1, 1.0])).tolist(), int(i % 2)) for i in range(900)]
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    want = brute.near_vectors(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicate_vectors(table, block=16, parts=4).collect()}
    assert got == want and any(n for n, _ in want.values())


@pytest.mark.parametrize("rows", [[(i, v) for i, v, _ in VECTORS if i not in (1, 11)], []])
def test_topk_oddities(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, d int, chunk string")
    got = sorted(tuple(r) for r in topk.top_products(table, k=2, block=2, shard=1, chunk=1).collect())
    assert got == brute.top_products(rows, k=2)


def test_topk_prunes_and_ties(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, (np.round(rng.normal(size=8) * 2) / 2).tolist()) for i in range(1500)]
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_products(table, block=32, shard=8, chunk=4).collect())
    assert got == brute.top_products(vectors)
    blocks = [(np.arange(4), m, m.min(axis=0), m.max(axis=0)) for m in (np.full((4, 2), x) for x in (1.0, 9.0, 2.0))]
    best, scored = topk.search_tile(np.ones((1, 2)), np.array([-1]), np.array([-np.inf]), blocks, 4)
    assert scored == 1 and [-s for s, _ in best.found[0]] == [18.0] * 4


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", '{"content": "wait", "tool_calls": [{"id": "c1", "name": "search", "arguments": {"query": "b", "limit": 3}}, '
     '{"id": "c2", "name": "search", "arguments": "{\\"limit\\": \\"x\\", \\"odd\\": 1}"}]}'),
    (1, 0, "tool", '{"tool_call_id": "c1", "content": "found"}'), (1, 3, "tool", '{"tool_call_id": "zz", "content": ""}'),
    (1, 2, "assistant", '{"tool_calls": [{"id": "c3", "name": "none", "arguments": {"q": {"$ref": "c1"}}}]}'),
    (1, 5, "assistant", '{"tool_calls": [{"id": "c1", "name": "fetch", "arguments": "no json"}]}'),
    (None, None, None, None), (2, 0, "user", '{"b": 1, "a": 2}'), (2, 1, "user", ""), (2, 1, "user", ""), (3, 0, "user", "{broken"),
]


@pytest.mark.parametrize("rows", [CHATS, []])
def test_chat(spark, rows):
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, row int")
    got = chat.format_chats(table, chat.schema_table(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        message = json.loads(r["message"])
        assert json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["message"]
    if not rows:
        return
    by = {(r["conv_id"], r["turn"], r["role"]): r for r in got}
    calls = json.loads(by[1, 1, "assistant"]["message"])["tool_calls"]
    assert [c["errors"] for c in calls] == ["", "missing:query,type:limit,unknown:odd"] and [c["result"] for c in calls] == [True, False]
    assert calls[0]["arguments"] == {"limit": 3, "query": "b"}
    result, referring = by[1, 0, "tool"], by[1, 2, "assistant"]
    assert (result["place"], result["step"]) == (1, 1) and (referring["place"], referring["step"]) == (2, 0)
    assert json.loads(referring["message"])["tool_calls"][0]["errors"] == "tool"
    assert json.loads(by[1, 3, "tool"]["message"])["linked"] is False
    assert json.loads(by[1, 5, "assistant"]["message"])["tool_calls"][0]["errors"] == "repeated,arguments"
    assert by[2, 0, "user"]["message"] == '{"content":"{\\"b\\": 1, \\"a\\": 2}","role":"user"}'


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
