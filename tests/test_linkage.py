"""Fusion, search, completion, metadata files and address ranges."""

import functools
import itertools
import random

from pyspark.sql import functions as F

from tidemark.operators import geo, linkage, search
from tidemark.sources import metadata

PAIR = "term_a string, term_b string, weight double, model string"
ONTO = "concept_a string, concept_b string, weight double"


def test_fusion_weights(spark):
    related = spark.createDataFrame(
        [("q", "t", 0.8, "userClicking"), ("q", "t", 0.9, "SWEET"), ("q", "low", 0.1, "SWEET")],
        "input string, term string, weight double, model string",
    )
    hits = {r["term"]: r["weight"] for r in linkage.fuse_terms(related).collect()}
    assert hits == {"t": 0.83, "low": 0.05}
    assert {r["term"]: r["weight"] for r in linkage.fuse_terms(related, "weight").collect()}["t"] == 0.88


def test_related_terms_both_sides_and_limits(spark):
    rows = [("sea ic", f"t{i:02d}", i / 100, "userHistory") for i in range(25)]
    rows += [("other", "sea ic", 0.9, "userClicking"), ("sea ic", "sea ic", 1.0, "userClicking")]
    concepts = [("sea ic", f"c{i:02d}", 0.75) for i in range(35)] + [("x", "sea ic", 0.9)]
    inputs = spark.createDataFrame([("Sea Ice",), ("none",)], "input string")
    got = linkage.related_terms(inputs, spark.createDataFrame(rows, PAIR), spark.createDataFrame(concepts, ONTO)).collect()
    by_model = {m: sorted(r["term"] for r in got if r["model"] == m) for m in ("userHistory", "userClicking", "SWEET")}
    assert by_model["userHistory"] == [f"t{i:02d}" for i in range(5, 25)]
    assert by_model["userClicking"] == ["other"]
    assert by_model["SWEET"] == [f"c{i:02d}" for i in range(30)]


def test_expansion_and_graph(spark):
    related = spark.createDataFrame(
        [("sea ice", "a b", 0.9, "userHistory"), ("sea ice", "c", 0.9, "userHistory"), ("sea ice", "d", 0.2, "userHistory")],
        "input string, term string, weight double, model string",
    )
    inputs = spark.createDataFrame([("sea ice",), ("lone",)], "input string")
    fused = linkage.fuse_terms(related)
    got = {r["input"]: r["query"] for r in linkage.expand_query(inputs, fused, 2).collect()}
    assert got == {"sea ice": "(sea AND ice) OR (c) OR (a AND b)", "lone": "(lone)"}
    text = {r["input"]: r["text"] for r in linkage.linked_terms_text(inputs, fused, 1).collect()}
    assert text == {"sea ice": "c = 0.85,", "lone": ""}
    graph = {r["input"]: r["graph"] for r in linkage.vocab_graph(inputs, related, 1).collect()}
    assert graph["lone"] == '{"nodes":[{"name":"lone","group":1}],"links":[]}'
    assert graph["sea ice"] == (
        '{"nodes":[{"name":"sea ice","group":1},{"name":"c","group":10}],"links":[{"source":1,"target":0,"value":0.9}]}'
    )


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_completion_finds_everything(spark):
    terms = ["".join(p) for n in (2, 4, 6) for p in itertools.islice(itertools.product("abc", repeat=n), 0, 300, 5)]
    typed = ["ab", "abc", "abca", "acbab", "bacabc", "cabcab", "a"]
    frame = spark.createDataFrame([(t, 1) for t in dict.fromkeys(terms)], "term string, n int")
    got = search.complete(spark.createDataFrame([(t,) for t in typed], "prefix string"), frame, 10_000).collect()
    want = set()
    for p, t in itertools.product(typed, dict.fromkeys(terms)):
        if len(p) < 3:
            hit = t.startswith(p)
        else:
            hit = t[0] == p[0] and any(edits(t[:n], p) <= 2 for n in range(max(len(p) - 2, 1), len(p) + 3))
        if hit:
            want.add((p, t))
    assert {(r["prefix"], r["term"]) for r in got} == want


def test_completion_of_random_words(spark):
    """Words of all lengths, inputs made of them by up to three edits."""
    rng = random.Random(4)
    words = list({"".join(rng.choice("abcde") for _ in range(rng.randint(0, 12))) for _ in range(400)})
    typed = set()
    for word in rng.sample(words, 120):
        text = list(word[:rng.randint(1, 12)])
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "e"])
        typed.add("".join(text))
    frame = spark.createDataFrame([(t, len(t) % 3) for t in words], "term string, n int")
    got = search.complete(spark.createDataFrame([(t,) for t in typed], "prefix string"), frame, 10_000).collect()
    want = set()
    for p, t in itertools.product(typed, words):
        if 0 < len(p) < 3 and t.startswith(p):
            want.add((p, t))
        if len(p) >= 3 and t[:1] == p[0] and any(edits(t[:n], p) <= 2 for n in range(max(len(p) - 2, 1), len(p) + 3)):
            want.add((p, t))
    assert {(r["prefix"], r["term"]) for r in got} == want
    best = search.complete(spark.createDataFrame([("abc",)], "prefix string"), frame, 2).collect()
    assert [r["term"] for r in sorted(best, key=lambda r: r["rank"])] == sorted((t for t in words if t[:1] == "a"), key=lambda t: (-(len(t) % 3), t))[:2]


def test_completion_among_a_million_terms_of_one_letter(spark):
    letters = F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz"])
    pick = [F.get(letters, F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(26)).cast("int")) for i in range(9)]
    terms = spark.range(1_000_000).select(F.concat(F.lit("q"), *pick).alias("term"), (F.col("id") % 97).alias("n")).distinct()
    typed = ["qzebras", "quartzit", "qwert"]
    frame = spark.createDataFrame([(t, len(t)) for t in typed], "prefix string, size int")
    candidates = search.completion_candidates(frame, search.completion_index(terms))
    met = {r["prefix"]: r["n"] for r in candidates.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(n < 150_000 for n in met.values())
    got = {(r["prefix"], r["term"]) for r in search.complete(frame, terms, 1_000_000).collect()}
    for p in typed:
        near = [F.levenshtein(F.left("term", F.lit(n)), F.lit(p), 2) >= 0 for n in range(len(p) - 2, len(p) + 3)]
        want = {r["term"] for r in terms.where(functools.reduce(lambda a, b: a | b, near)).select("term").collect()}
        assert {t for q, t in got if q == p} == want and want


def test_search_needs_all_words_of_a_part(spark):
    docs = spark.createDataFrame([(1, "sea ice melts"), (2, "sea winds"), (3, "gravity of ice and sea ice")], "doc int, text string")
    groups = spark.createDataFrame([("q", 0, "Sea Ice"), ("q", 1, "wind"), ("z", 0, "nothing here")], "input string, part int, phrase string")
    hits = search.search_metadata(groups, search.postings(docs)).orderBy("rank").collect()
    assert {r["doc"] for r in hits} == {1, 2, 3} and {r["input"] for r in hits} == {"q"}
    assert hits[0]["relevance"] == 100.0
    names = docs.select("doc", F.lit("s").alias("short_name"), F.lit("l").alias("long_name"), F.lit("k").alias("keyword"), F.col("text").alias("abstract"))
    records = search.result_json(search.search_metadata(groups, search.postings(docs), k=1), names).collect()
    assert len(records) == 1 and '"Relevance":"100.00%"' in records[0]["record"]


def test_address_ranges(spark):
    ips = spark.createDataFrame([("10.0.0.5",), ("10.0.0.5",), ("10.1.255.255",), ("10.3.0.0",), ("9.0.0.1",), ("bad",)], "ip string")
    n = lambda a, b, c, d: (a << 24) + (b << 16) + (c << 8) + d
    ranges = spark.createDataFrame([(n(10, 0, 0, 0), n(10, 0, 0, 9), "x"), (n(10, 0, 1, 0), n(10, 2, 0, 0), "y")], "lo bigint, hi bigint, location string")
    got = {r["ip"]: r["location"] for r in geo.locate(ips, ranges).collect()}
    assert got == {"10.0.0.5": "x", "10.1.255.255": "y", "10.3.0.0": None, "9.0.0.1": None, "bad": None}


def test_metadata_files(spark, tmp_path):
    row = ("S", 'A "long" name', "k1, k2", "t", "p", "v", "50% & more")
    frame = spark.createDataFrame([row, ("B", "b", "k", "t", "p", "v", None)], "short_name string, long_name string, keyword string, term string, topic string, variable string, abstract string")
    metadata.write_json(frame, str(tmp_path / "j"))
    back = {r["short_name"]: r for r in metadata.read_json(spark, str(tmp_path / "j")).collect()}
    assert back["S"]["abstract"] == "50% & more" and back["S"]["long_name"] == "A long name" and back["B"]["abstract"] is None
    metadata.write_split(frame, str(tmp_path / "with"), str(tmp_path / "without"))
    assert spark.read.parquet(str(tmp_path / "with")).count() == spark.read.parquet(str(tmp_path / "without")).count() == 1
    (tmp_path / "d.txt").write_text("s, long, topic, term, var, k1, k2\nshort, line\n")
    assert [tuple(r) for r in metadata.read_delimited(spark, str(tmp_path / "d.txt")).collect()] == [("s", "long", "topic", "term", "var", "k1, k2")]
    (tmp_path / "d.xml").write_text(
        "<DIF><Entry_ID>e</Entry_ID><Entry_Title>t</Entry_Title><Summary><Abstract> a </Abstract></Summary>"
        "<ISO_Topic_Category>x</ISO_Topic_Category><ISO_Topic_Category>y</ISO_Topic_Category>"
        "<Sensor_Name><Short_Name>s</Short_Name><Long_Name>sl</Long_Name></Sensor_Name></DIF>"
    )
    dif = metadata.read_dif(spark, str(tmp_path / "d.xml")).first()
    assert (dif["short_name"], dif["abstract"], dif["isotopic"], dif["sensor"]) == ("e", "a", "x,y", "s,sl")
