"""Topic model input and output, labelled corpora and corpus word counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import underscore_tokens
from tidemark.operators.matrix import dense_ids
from tidemark.session import stage


def topic_tokens(*fields: str) -> Column:
    """Tokens of several space-separated fields of one dataset, in field order."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(F.split(F.col(f), " "), empty) for f in fields])


def word_bags(documents: DataFrame) -> DataFrame:
    """(bag, copies, word, n): the words of every distinct bag of (doc, tokens), how often the bag has them, and its documents."""
    bags = documents.select(F.array_sort(F.filter("tokens", lambda t: t.isNotNull())).alias("tokens")).where(F.size("tokens") > 0)
    bags = bags.groupBy("tokens").agg(F.count(F.lit(1)).alias("copies"))
    bags = stage(bags.select(F.monotonically_increasing_id().alias("bag"), "copies", "tokens"), "topic-bags")
    # A copy of the bag's hash travels with its words: random starts follow from what a bag holds, not from where it lies.
    words = bags.select("bag", "copies", F.xxhash64("tokens").alias("mark"), F.explode("tokens").alias("word"))
    return words.groupBy("bag", "copies", "mark", "word").agg(F.count(F.lit(1)).alias("n"))


def lda_topics(
    documents: DataFrame, k: int = 8, concentration: float = 2.0, iterations: int = 50, seed: int = 0, words: int = 10,
) -> DataFrame:
    """(topic, rank, word, weight) of an EM topic model over (doc, tokens).

    Expectation maximisation of smoothed counts (both concentrations less one are added) over bags of words. Documents of
    equal words start alike and stay alike, so each distinct bag is worked out once and counts as often as it has documents.
    A round is two sums of the shares of topics, by word and by bag, joined back to the cells; the vocabulary is a table
    and is kept whole, the driver holds none of it. Random starts are hashes of bag, word and seed, so reruns agree
    whatever the partitions.
    """
    if concentration <= 1:
        raise ValueError("EM needs a concentration above 1")
    topics, prior = range(k), F.lit(concentration - 1)
    start = [(F.pmod(F.xxhash64("mark", "word", F.lit(seed), F.lit(t)), F.lit(1 << 20)) + 1).cast("double") for t in topics]

    def shares(rows: DataFrame, raw: list[Column]) -> DataFrame:
        rows = rows.select("bag", "copies", "word", "n", *[r.alias(f"g{t}") for t, r in enumerate(raw)])
        whole = reduce(Column.__add__, [F.col(f"g{t}") for t in topics])
        return stage(rows.select("bag", "copies", "word", "n", *[(F.col(f"g{t}") / whole).alias(f"g{t}") for t in topics]), "topic-shares")

    def by_word(cells: DataFrame) -> DataFrame:
        return cells.groupBy("word").agg(*[F.sum(F.col("copies") * F.col("n") * F.col(f"g{t}")).alias(f"w{t}") for t in topics])

    def totals(of_words: DataFrame) -> DataFrame:
        return of_words.agg(F.count(F.lit(1)).alias("vocabulary"), *[F.sum(f"w{t}").alias(f"s{t}") for t in topics])

    cells = shares(word_bags(documents), start)
    for _ in range(iterations):
        of_words = by_word(cells)
        of_bags = cells.groupBy("bag").agg(*[F.sum(F.col("n") * F.col(f"g{t}")).alias(f"b{t}") for t in topics])
        met = cells.select("bag", "copies", "word", "n").join(of_words, "word").join(of_bags, "bag").crossJoin(F.broadcast(totals(of_words)))
        cells = shares(met, [
            (F.col(f"w{t}") + prior) * (F.col(f"b{t}") + prior) / (F.col(f"s{t}") + F.col("vocabulary") * prior) for t in topics
        ])
    of_words = by_word(cells)
    weights = [F.struct(F.lit(t).alias("topic"), (F.col(f"w{t}") / F.col(f"s{t}")).alias("weight")) for t in topics]
    told = of_words.crossJoin(F.broadcast(totals(of_words))).select("word", F.inline(F.array(*weights)))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "word"))
    return told.withColumn("rank", rank).where(F.col("rank") <= words).select("topic", "rank", "word", "weight")


def corpus_tokens(abstract: Column, *name_lists: Column) -> Column:
    """Abstract tokens followed by the names of each list with their spaces turned into underscores."""
    return F.concat_ws(" ", abstract, *[underscore_tokens(names) for names in name_lists])


def label_ids(labelled: DataFrame) -> DataFrame:
    """(label, id) with dense ids in label order from rows (short_name, labels array, tokens)."""
    return dense_ids(labelled.select(F.explode("labels").alias("label")), "label")


def labelled_corpus(labelled: DataFrame) -> DataFrame:
    """(short_name, label_ids, tokens): distinct label ids of each dataset, empty when it has none."""
    single = labelled.select("short_name", F.explode("labels").alias("label")).distinct()
    with_id = single.join(label_ids(labelled), "label", "left")
    per_name = with_id.groupBy("short_name").agg(F.array_sort(F.collect_list("id")).alias("label_ids"))
    empty = F.array().cast("array<bigint>")
    return labelled.select("short_name", "tokens").join(per_name, "short_name", "left").withColumn(
        "label_ids", F.coalesce("label_ids", empty)
    )


def word_counts(texts: DataFrame) -> DataFrame:
    """Occurrences of every space-separated word of a column ``tokens``, compound names left out."""
    words = texts.select(F.explode(F.split("tokens", " ")).alias("word"))
    return (
        words.where(~F.contains("word", F.lit("_"))).groupBy("word")
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word")
    )
