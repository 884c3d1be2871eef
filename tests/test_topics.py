"""The topic model over distinct bags of words."""

from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import topics


def test_topics_of_distinct_bags(spark):
    """Equal documents are one bag that counts as often; no number of partitions changes the result; no word is lost."""
    bags = [["sea", "ice", "sea"], ["ice", "sea", "sea"], ["wind", "wave"], ["wind", "wave", None], ["salt"], []]
    documents = spark.createDataFrame([(i, bags[i % 6]) for i in range(60)], "doc int, tokens array<string>")
    got = {(r["copies"], r["word"]): r["n"] for r in topics.word_bags(documents).collect()}
    assert got == {(20, "sea"): 2, (20, "ice"): 1, (20, "wind"): 1, (20, "wave"): 1, (10, "salt"): 1}
    runs = []
    for parts in (1, 7):
        rows = topics.lda_topics(documents.repartition(parts), k=2, iterations=4, words=9).collect()
        runs.append({(r["topic"], r["word"]): r["weight"] for r in rows})
        assert Counter(r["topic"] for r in rows) == {0: 5, 1: 5} and sorted(r["rank"] for r in rows if not r["topic"]) == [1, 2, 3, 4, 5]
        assert all(abs(sum(r["weight"] for r in rows if r["topic"] == t) - 1) < 1e-9 for t in range(2))
    assert runs[0].keys() == runs[1].keys() and all(abs(runs[0][k] - runs[1][k]) < 1e-9 for k in runs[0])
    assert topics.lda_topics(documents.where(F.lit(False)), k=2, iterations=1).collect() == []
