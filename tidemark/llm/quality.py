"""Quality classifier: a modified Kneser-Ney character n-gram model of trusted text.

Counts come from all trusted documents, keyed by language. Continuation counts, discounts, context sums and
back-off weights are joins and aggregations of count tables in Spark. In logarithms an interpolated
probability is a sum over the n-grams of all orders that end at a position:

    log p = log p0 + sum over seen contexts of log(back-off) + sum over seen n-grams of gain,
    gain(g) = log p(g) - log(back-off of g's context) - log p(g without its first symbol)

so a document's log-probability is the sum of one value for each n-gram it holds, and a model in shards
gives partial sums that add up. Documents are never shuffled to be scored; the shards travel, each of a
bounded size, and a larger model has more of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import bounded_batches
from tidemark.llm.joins import ids_side
from tidemark.llm.rows import fresh, with_row_number
from tidemark.session import stage, stage_result

ORDER = 5
SYMBOL_BITS = 8
SHARD_GRAMS = 1 << 20  # n-grams of one shard of the model: 20 bytes each on an executor
QUANTILE = 0.995  # of the trusted documents of a language stay under its threshold
STEPS_PER_NAT = 1000  # resolution of the quantile, in log-perplexity
CHUNK = 1 << 18  # symbols looked up at once
BEGIN, END, OTHER = 1, 2, 3


def symbols() -> np.ndarray:
    """Code point -> symbol: printable ASCII and Latin-1 letters are themselves, digits one, spaces one.

    Code points above are folded by their block of 128 onto 24 symbols.
    """
    table = np.full(0x110000, OTHER, np.uint8)
    points = np.arange(0x110000)
    table[points >= 0x100] = 8 + (points[points >= 0x100] >> 7) % 24
    table[0x21:0x7F] = np.arange(0x21, 0x7F)
    table[0xA1:0x100] = np.arange(0xA1, 0x100)
    table[ord("0"):ord("9") + 1] = ord("0")
    table[[0x20, 0xA0, *range(0x09, 0x0E)]] = 0x20
    return table


def runs_of_symbols(texts: list[str], order: int, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, start of each document's part, its number in texts), a bounded number of symbols at once.

    A document is order - 1 begin marks, its symbols and an end mark; where one is cut, the next part
    repeats the last order - 1 symbols.
    """
    parts, owners, held = [], [], 0
    pad = np.full(order - 1, BEGIN, np.uint8)
    for i, text in enumerate(texts):
        whole = np.concatenate([pad, table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], [END]]).astype(np.uint8)
        for at in range(order - 1, len(whole), CHUNK):
            part = whole[at - order + 1:at + CHUNK]
            parts.append(part)
            owners.append(i)
            held += len(part)
            if held >= CHUNK:
                yield _joined(parts, owners)
                parts, owners, held = [], [], 0
    if parts:
        yield _joined(parts, owners)


def _joined(parts: list[np.ndarray], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])).astype(np.int64)
    return np.concatenate(parts), starts, np.array(owners, np.int64)


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """The packed n-gram that ends at each position; nonsense at the first n - 1."""
    out = codes.astype(np.int64)
    total = out.copy()
    for k in range(1, n):
        total[k:] |= out[:-k] << (SYMBOL_BITS * k)
    return total


def _language(batch: pa.RecordBatch, column: int) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, g, n): counts of the packed n-grams of the highest order, from docs (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbols()
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(_language(batch, 0), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text or "")
            for lang, texts in by_lang.items():
                for codes, starts, _ in runs_of_symbols(texts, order, table):
                    keys = grams(codes, order)
                    event = np.ones(len(codes), bool)
                    for k in range(order - 1):
                        event[starts + k] = False
                    found, n = np.unique(keys[event], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found)), pa.array(found), pa.array(n.astype(np.int64))], ["lang", "g", "n"]
                    )

    partial = bounded_batches(docs).select("lang", F.col("text").cast("string")).mapInArrow(run, "lang string, g bigint, n bigint")
    return partial.groupBy("lang", "g").agg(F.sum("n").alias("n"))


def _discounts(level: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) of one order: the closed forms from how many n-grams have 1, 2, 3 and 4 counts."""
    n = {k: F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double") for k in (1, 2, 3, 4)}
    sums = level.groupBy("lang").agg(*[n[k].alias(f"n{k}") for k in n])
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))

    def d(k: int) -> Column:
        value = k - F.try_divide((k + 1) * y * F.col(f"n{k + 1}"), F.col(f"n{k}"))
        usual = F.lit(0.5 * k if k < 3 else 1.5)
        return F.when((F.col(f"n{k}") > 0) & (value > 0) & (value < k), value).otherwise(usual)

    return sums.select("lang", d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3"))


def train(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, size, g, gain, back): the values of every n-gram of every order, g packed, size its length.

    `gain` is null for a string that is only a context (of begin marks), `back` for one that is no context.
    The n-gram of length 0, the context of single symbols, is g = 0.
    """
    level = stage(count_grams(trusted, order), "ngram-counts")
    levels = {order: level}
    for size in range(order - 1, 0, -1):
        mask = (1 << (SYMBOL_BITS * size)) - 1
        levels[size] = stage(
            levels[size + 1].groupBy("lang", F.col("g").bitwiseAND(F.lit(mask)).alias("g")).agg(F.count(F.lit(1)).alias("n")),
            "ngram-continuations",
        )
    probability, model = None, None
    for size in range(1, order + 1):
        level = levels[size].withColumn("context", F.shiftright("g", SYMBOL_BITS))
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        cut = level.join(F.broadcast(_discounts(level)), "lang").withColumn("d", d)  # one row for each language
        sums = cut.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("mass"))
        cut = cut.join(sums, ["lang", "context"]).withColumn("back", F.col("mass") / F.col("total"))
        own = (F.col("n") - F.col("d")) / F.col("total")
        if size == 1:
            lower = cut.withColumn("lower", F.lit(2.0 ** -SYMBOL_BITS))
        else:
            suffix = F.col("g").bitwiseAND(F.lit((1 << (SYMBOL_BITS * (size - 1))) - 1))
            lower = cut.withColumn("suffix", suffix).join(
                probability.select("lang", F.col("g").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"]
            )
        scored = stage(
            lower.withColumn("p", own + F.col("back") * F.col("lower"))
            .select("lang", "g", "context", "p", "back", (F.log("p") - F.log("back") - F.log("lower")).alias("gain")),
            "ngram-probabilities",
        )
        gains = scored.select("lang", F.lit(size).alias("size"), "g", "gain", F.lit(None).cast("double").alias("back"))
        backs = scored.select(
            "lang", F.lit(size - 1).alias("size"), F.col("context").alias("g"),
            F.lit(None).cast("double").alias("gain"), F.log("back").alias("back"),
        ).distinct()
        probability = scored
        both = gains.unionByName(backs)
        model = both if model is None else model.unionByName(both)
    return stage(model.groupBy("lang", "size", "g").agg(F.max("gain").alias("gain"), F.max("back").alias("back")), "ngram-model")


class Shard:
    """Values of n-grams by key, in an open table: language, length and symbols are mixed into the slot."""

    def __init__(self, keys: np.ndarray, gains: np.ndarray, backs: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.index = np.full(1 << self.bits, len(keys), np.int32)
        self.gains, self.backs = np.append(gains, 0.0), np.append(backs, 0.0)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            s = slots[left]
            free = self.keys[s] == -1
            first = np.unique(s[free], return_index=True)[1]
            put = left[free][first]
            self.keys[slots[put]], self.index[slots[put]] = keys[put], put
            left = np.setdiff1d(left, put, assume_unique=True)
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; the number of keys where it isn't there."""
        slots = self._slot(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.index[slots], len(self.gains) - 1)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slots[left]]
            hit = there == keys[left]
            out[left[hit]] = self.index[slots[left[hit]]]
            left = left[~hit & (there != -1)]
        return out


def tagged(keys: np.ndarray, size: int, language: int) -> np.ndarray:
    """Keys of n-grams of all lengths and languages in one number: 40 bits of symbols, 3 of length, the rest language."""
    return keys | ((language * 8 + size) << (SYMBOL_BITS * ORDER))


def _score(docs: DataFrame, shard: tuple, languages: dict[str, int], order: int, base: bool) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, found = symbols(), Shard(*sent.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            langs = np.array([languages.get(x, -1) for x in _language(batch, 1)])
            sums = np.zeros(len(texts))
            for number in np.unique(langs[langs >= 0]):
                picked = np.flatnonzero(langs == number)
                for codes, starts, owners in runs_of_symbols([texts[i] for i in picked], order, table):
                    part = np.zeros(len(codes))
                    # An event is every position after the first order - 1 of a part.
                    for size in range(order + 1):
                        if size == 0:
                            at = np.full(len(codes), found.find(tagged(np.zeros(1, np.int64), 0, int(number)))[0])
                        else:
                            at = found.find(tagged(grams(codes, size), size, int(number)))
                            part += found.gains[at]
                        if size < order:
                            part[1:] += found.backs[at[:-1]]
                    for k in range(order - 1):
                        part[starts + k] = 0.0
                    np.add.at(sums, picked[owners], np.add.reduceat(part, starts))
            n = np.array([len(t) + 1 for t in texts], np.int64) * (langs >= 0)
            if base:
                sums -= n * (SYMBOL_BITS * np.log(2.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums), pa.array(n if base else 0 * n, pa.int64())], ["row", "logprob", "n"]
            )

    return bounded_batches(docs).select("row", "lang", "text").mapInArrow(run, "row bigint, logprob double, n bigint")


def score(docs: DataFrame, model: DataFrame, order: int = ORDER, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """(row, logprob, n): each document's log-probability under its language's model and its number of events, 0 without a model.

    The model is read shard by shard, each at most about `shard_grams` n-grams; partial sums are added.
    """
    assert order <= ORDER
    names = [x["lang"] for x in model.select("lang").distinct().orderBy("lang").collect()]  # one row for each language
    languages = {lang: i for i, lang in enumerate(names)}
    shards = max(1, -(-model.count() // shard_grams))
    number = F.array_position(F.lit(names or [""]), F.col("lang")).cast("bigint") - 1
    model = stage(
        model.select(
            F.pmod(F.xxhash64("lang", "size", "g"), F.lit(shards)).cast("int").alias("shard"),
            F.col("g").bitwiseOR(F.shiftleft(number * 8 + F.col("size"), SYMBOL_BITS * ORDER)).alias("key"),
            F.coalesce("gain", F.lit(0.0)).alias("gain"), F.coalesce("back", F.lit(0.0)).alias("back"),
        ),
        "ngram-shards",
    )
    parts = []
    for s in range(shards):
        rows = model.where(F.col("shard") == s).select("key", "gain", "back").toArrow()
        shard = tuple(rows.column(c).to_numpy() for c in ("key", "gain", "back"))
        parts.append(_score(docs, shard, languages, order, s == 0))
        del rows, shard  # the executors have it
    if shards == 1:
        return parts[0]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("row").agg(F.sum("logprob").alias("logprob"), F.sum("n").alias("n"))


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, threshold): the exact quantile of the log-perplexity of trusted documents, to 1 / STEPS_PER_NAT."""
    bins = scored.where("trusted and nats is not null").groupBy("lang", F.ceil(F.col("nats") * STEPS_PER_NAT).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    return bins.where(F.col("upto") >= F.ceil(F.col("all") * quantile)).groupBy("lang").agg(
        (F.min("bin") / STEPS_PER_NAT).alias("threshold")
    )


def judged(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, order: int = ORDER, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """(row, doc_id, lang, trusted, n_events, logprob, perplexity, threshold, kept) of every row of docs (doc_id, lang, text).

    `trusted_ids` (doc_id) names the trusted documents. Documents are dealt into two folds by a hash of their
    id; each language has a model of all trusted documents of each fold, and a document is scored by that of
    the other fold, so none is measured by a model that has seen it. A document is kept unless its perplexity
    (for each character) is above the given quantile of its language's trusted documents. Languages without
    trusted text reject nothing and have a null perplexity. A null language is a language of its own. Null and empty texts are one end mark, a
    perplexity like any other, and always kept. Repeated rows are judged each; repeated ids in
    `trusted_ids` count once. Other columns of docs are not read.
    """
    key = fresh(docs, "row")
    plain = with_row_number(docs, key).select(F.col(key).alias("row"), "doc_id", "lang", "text")
    return judged_rows(plain, trusted_ids, quantile, order, shard_grams)


def judged_rows(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, order: int = ORDER, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """`judged` of rows with a `row` number that is the same at every reading."""
    trusted = trusted_ids.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2))
    docs = docs.select(
        "row", F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.concat(F.lit("l:"), F.col("lang").cast("string")), F.lit("")).alias("lang"),
        F.col("text").cast("string").alias("text"),
    )
    trusted = stage(trusted, "trusted-ids")
    flagged = docs.drop("row").join(ids_side(trusted), F.col("doc_id") == F.col("_id"), "left_semi")
    model = train(flagged.select(F.concat(fold, F.lit("/"), "lang").alias("lang"), "text"), order)
    scores = score(docs.select("row", F.concat(1 - fold, F.lit("/"), "lang").alias("lang"), "text"), model, order, shard_grams)
    rows = docs.select("row", "doc_id", "lang", (F.coalesce(F.length("text"), F.lit(0)) == 0).alias("blank"))
    scored = stage(
        rows.join(scores, "row").join(trusted.withColumn("trusted", F.lit(True)), F.col("doc_id") == F.col("_id"), "left")
        .select("row", "doc_id", "lang", "blank", F.coalesce("trusted", F.lit(False)).alias("trusted"), "n", "logprob",
                F.try_divide(-F.col("logprob"), F.col("n")).alias("nats")),
        "perplexities",
    )
    limits = thresholds(scored, quantile)
    out = scored.join(limits, "lang", "left")
    return out.select(
        "row", "doc_id", F.when(F.col("lang") != "", F.substring("lang", 3, 1 << 30)).alias("lang"), "trusted",
        F.col("n").alias("n_events"), "logprob",
        F.exp("nats").alias("perplexity"), F.exp("threshold").alias("threshold"),
        (F.col("blank") | F.coalesce(F.col("nats") <= F.col("threshold"), F.lit(True))).alias("kept"),
    )


def kept_documents(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns.

    Verdicts meet texts by the row's number in the files, so the tables may be read in any number of tasks. No
    rows in, no rows out; nulls, empty texts, repeated rows and ids as in `judged`. Columns of any name stay.
    """
    row = fresh(docs, "_row")
    numbered = with_row_number(docs, row)
    plain = numbered.select(F.col(row).alias("row"), "doc_id", "lang", "text")
    rejected = stage_result(
        docs.sparkSession, lambda: judged_rows(plain, trusted_ids, quantile).where("not kept").select(F.col("row").alias(row)), "rejected"
    )
    return numbered.join(ids_side(rejected), row, "left_anti").select(*docs.columns)
