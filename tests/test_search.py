"""Ranked search in blocks against plain loops."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tidemark.operators import search

GROUPS = "input string, part int, phrase string"


@pytest.fixture(scope="module")
def corpus():
    """Texts of 3 to 200 words from a vocabulary whose first words are in nearly every text; a few texts repeat."""
    draw = random.Random(11)
    words = [f"w{i}q" for i in range(60)]
    texts = [
        " ".join(words[min(int(draw.expovariate(0.12)), 59)] for _ in range(draw.choice([3, 8, 40, 200])))
        for _ in range(400)
    ]
    return list(enumerate(texts + texts[:20] + [""]))


def brute(corpus, asked, k):
    counts = {doc: Counter(text.split()) for doc, text in corpus if text}
    mean = sum(sum(c.values()) for c in counts.values()) / len(counts)
    df = Counter(w for c in counts.values() for w in c)
    out = {}
    for name, parts in asked.items():
        scores = defaultdict(float)
        for part in parts:
            terms = sorted(set(part.split()))
            for doc, c in counts.items():
                if all(t in c for t in terms):
                    for t in terms:
                        idf = math.log(1 + (len(counts) - df[t] + 0.5) / (df[t] + 0.5))
                        scores[doc] += idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
        best = sorted(((-round(s, 8), doc) for doc, s in scores.items()))[:k]
        out[name] = [(i + 1, doc, -s) for i, (s, doc) in enumerate(best)]
    return {name: hits for name, hits in out.items() if hits}


ASKED = {
    "frequent": ["w0q"], "both": ["w0q w1q"], "parts": ["w2q w3q", "w9q", "w0q w20q"], "rare": ["w55q"],
    "absent": ["nowhere"], "half absent": ["w1q nowhere", "w4q"], "same twice": ["w5q w5q", "w5q"],
}


@pytest.mark.parametrize("k,block_docs", [(1, 8), (12, 4), (500, 256)])
def test_blocks_give_what_all_documents_give(spark, corpus, k, block_docs):
    index = search.postings(spark.createDataFrame(corpus, "doc long, text string"))
    groups = spark.createDataFrame([(n, i, p) for n, parts in ASKED.items() for i, p in enumerate(parts)], GROUPS)
    got = defaultdict(list)
    for r in search.search_metadata(groups, index, k, block_docs).orderBy("input", "rank").collect():
        got[r["input"]].append((r["rank"], r["doc"], pytest.approx(r["score"], abs=2e-8)))
        assert (r["relevance"] == 100) if r["rank"] == 1 else (0 < r["relevance"] <= 100)
    assert dict(got) == brute(corpus, ASKED, k)


def test_blocks_under_the_last_score_are_not_scored(spark, corpus):
    postings = search.impact_postings(search.postings(spark.createDataFrame(corpus, "doc long, text string")), block_docs=8).cache()
    terms = search.query_terms(spark.createDataFrame([("frequent", 0, "w0q"), ("both", 0, "w0q w1q")], GROUPS))
    cells = search.block_bounds(terms, postings).groupBy("input").count().collect()
    scored = Counter(r["input"] for done, _ in search.scoring_rounds(terms, postings, 5) for r in done.collect())
    assert all(r["count"] > 45 for r in cells) and len(cells) == 2
    assert scored["frequent"] < 12 and scored["both"] < 30
    postings.unpersist()


def test_prebuilt_index_and_empty_tables(spark, corpus):
    counts = search.postings(spark.createDataFrame(corpus, "doc long, text string"))
    groups = spark.createDataFrame([("parts", 0, "w2q w3q"), ("null", 0, None), ("blank", 0, "")], GROUPS)
    once = search.impact_postings(counts, block_docs=16).cache()
    assert sorted(search.search_metadata(groups, once, 7).collect()) == sorted(search.search_metadata(groups, counts, 7).collect())
    once.unpersist()
    none = spark.createDataFrame([], "doc long, text string")
    assert search.search_metadata(groups, search.postings(none)).count() == 0
    assert search.search_metadata(spark.createDataFrame([], GROUPS), counts).count() == 0
