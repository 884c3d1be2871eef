"""Phrase collocations from count streams in prefix and suffix order.

Grams of one to four words are counted level by level: a gram can reach the least count only where all its
parts do, so pairs are counted between frequent words, longer grams over frequent pairs. Where a gram may be
frequent is read from a bitmap of fixed size, whose false hits cost time and change nothing. Tasks count
sorted chunks of their own before anything is shuffled. The counts then lie in two orders: a stream sorted
by its first words is merged with the stream of one word less to get the counts of its left parts, one
sorted by its last words for the right parts; the largest counts of longer grams over a shorter one come
from the same streams. These are sort-merge joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STOPS = ",;:!?\n\x0b\x0c\r"  # and the full stop, which stands for them all
LONGEST = 4
LEAST = 30
SCALE = 2_000_000
COVER = (80, 100)  # a longer candidate with this share of the occurrences drops the shorter
BEST = 2000
CHUNK = 1 << 20  # words that a task counts at once
SENT = 1 << 16  # rows of a batch that leaves a task: both of its sides hold it whole
MOST_BITS = 1 << 28  # of a bitmap, 32 MB; a fuller one lets more through
BITS_EACH = 16
PART = 15  # log2 of the bits that one aggregated bitmap holds
ROWS, BYTES = 500, 8 << 20  # of a batch that enters a task


def words_of(text: Column) -> Column:
    """Words of the whole text after lower-casing A-Z, and `.` at each end of a piece; no word is a `.`."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + STOPS + "\t", LOWER + "." * len(STOPS) + " ")
    return F.array_remove(F.split(F.replace(low, F.lit("."), F.lit(" . ")), " ", -1), "")


def word_id(lang: Column, word: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), lang, word)


def vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, id, n) of every word of each lang and the seed of its ids, under which no two words share one.

    Ids are 64-bit hashes, checked over the whole vocabulary; another seed is taken in the rare case that two
    words meet or one meets 0, the end of a piece.
    """
    words = stage(
        docs.select("lang", F.explode(words_of(F.col("text"))).alias("word")).where("word != '.'")
        .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")),
        "words",
    )
    seed = 42
    while True:
        known = words.withColumn("id", word_id(F.col("lang"), F.col("word"), seed))
        if known.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1 or id = 0").isEmpty():
            return known, seed
        seed += 1


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches to Python hold `ROWS` rows and about `BYTES` bytes while the block runs."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BYTES)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One 64-bit number of two; for the bitmap and for sorting, never as an identity."""
    both = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.view(np.uint64)
    both ^= both >> np.uint64(29)
    return both * np.uint64(0xBF58476D1CE4E5B9)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x94D049BB133111EB)) >> np.uint64(65 - bits.bit_length())


def _holds(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slots = _slots(keys, len(bitmap) * 8)
    return (bitmap[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap_of(keys: DataFrame, rows: int) -> np.ndarray:
    """A bitmap of the `key` column (numbers), `BITS_EACH` bits a row up to `MOST_BITS`.

    Its parts of 4096 bytes are put together by Spark; what reaches the driver is bounded by the bitmap's size.
    """
    bits = min(MOST_BITS, max(1 << PART, 1 << (rows * BITS_EACH).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(batch.column(0).to_numpy(), bits)).astype(np.int64))], ["slot"])

    part, place = F.shiftright("slot", PART).alias("part"), F.col("slot").bitwiseAND((1 << PART) - 1)
    found = keys.select("key").mapInArrow(slots, "slot bigint").groupBy(part).agg(F.bitmap_construct_agg(place).alias("bits"))
    bitmap = np.zeros((bits >> PART, 1 << (PART - 3)), np.uint8)
    table = found.toArrow()
    for number, held in zip(table["part"].to_pylist(), table["bits"].to_pylist(), strict=True):
        bitmap[number] = np.frombuffer(held, np.uint8)
    return bitmap.ravel()


def _counted(ids: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct run of `size` words among those that begin `at`, in the order of a mixed key, and how often it occurs.

    Runs that share a key without being equal only split a run's count, which the sum over all tasks mends.
    """
    key = ids[at]
    for k in range(1, size):
        key = _mixed(key, ids[at + k]).view(np.int64)
    at = at[np.argsort(key)]
    new = np.zeros(len(at), bool)
    new[:1] = True
    for k in range(size):
        word = ids[at + k]
        new[1:] |= word[1:] != word[:-1]
    starts = np.flatnonzero(new)
    return at[starts], np.diff(np.append(starts, len(at)))


def pair_grams(ids: np.ndarray, frequent_words: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Where the pairs of neighbouring words that may both be frequent begin, and their size; `ids` has 0 at each end of a piece."""
    may = (ids != 0) & _holds(frequent_words, ids)
    yield np.flatnonzero(may[:-1] & may[1:]), 2


def long_grams(ids: np.ndarray, frequent_pairs: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Where the runs of three and of four words all of whose pairs may be frequent begin, and their size."""
    linked = (ids[:-1] != 0) & (ids[1:] != 0)
    linked[linked] = _holds(frequent_pairs, _mixed(ids[:-1][linked], ids[1:][linked]).view(np.int64))
    three = linked[:-1] & linked[1:]
    yield np.flatnonzero(three), 3
    yield np.flatnonzero(three[:-1] & three[1:]), 4


GRAM = ["w1", "w2", "w3", "w4"]


def counted_grams(ids: np.ndarray, grams, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(w1..w4, n) of the grams found in a chunk, 0 after the last word, in batches of `SENT` rows."""
    for found, size in grams(ids, bitmap):
        at, n = _counted(ids, found, size)
        for low in range(0, len(at), SENT):
            part = at[low:low + SENT]
            words = [ids[part + k] for k in range(size)] + [np.zeros(len(part), np.int64)] * (LONGEST - size)
            yield pa.RecordBatch.from_arrays([pa.array(w) for w in [*words, n[low:low + SENT]]], [*GRAM, "n"])


def gram_counts(docs: DataFrame, seed: int, grams, bitmap: np.ndarray, least: int) -> DataFrame:
    """(w1..w4, n) of the grams that occur `least` times, 0 after the last word; staged.

    Texts become ids in the JVM; tasks find and count grams by the chunk.
    """
    spark = docs.sparkSession
    ended = F.concat(words_of(F.col("text")), F.array(F.lit(".")))
    ids = docs.select(F.transform(ended, lambda w: F.when(w == ".", F.lit(0)).otherwise(word_id(F.col("lang"), w, seed))).alias("ids"))
    sent = spark.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size >= CHUNK:
                whole, held, size = np.concatenate(held), [], 0
                yield from counted_grams(whole, grams, sent.value)
        if held:
            yield from counted_grams(np.concatenate(held), grams, sent.value)

    counted = ids.mapInArrow(count, ", ".join(f"{g} bigint" for g in GRAM) + ", n bigint")
    with small_batches(spark):
        table = stage(counted.groupBy(*GRAM).agg(F.sum("n").alias("n")).where(F.col("n") >= least), "grams")
    sent.destroy()
    return table


def _parts(streams: dict[int, DataFrame]) -> DataFrame:
    """(w1..w4, n, size, lefts, rights, longer) of the grams of two words and more.

    lefts[k - 1] and rights[k - 1] are the counts of a gram's first k and last size - k words, longer is the
    largest count of a gram of one word more that holds it (0 without any).
    """
    none = F.array().cast("array<bigint>")
    prefix = streams[1].select("w1", F.col("n").alias("part"), none.alias("parts"))
    suffix = prefix
    found = None
    for size in range(2, LONGEST + 1):
        words = GRAM[:size]
        first, last = words[:-1], words[1:]
        by_last = suffix.select(*[F.col(a).alias(b) for a, b in zip(first, last, strict=True)], "part", "parts")
        lefts = streams[size].join(prefix.hint("merge"), first).select(*words, "n", F.concat("parts", F.array("part")).alias("lefts"))
        rights = streams[size].join(by_last.hint("merge"), last).select(*words, F.concat(F.array("part"), "parts").alias("rights"))
        grams = lefts.join(rights.hint("merge"), words)
        if size < LONGEST:
            longer, more = streams[size + 1], GRAM[:size + 1]
            right = longer.groupBy(*words).agg(F.max("n").alias("to_right"))
            left = longer.groupBy(*[F.col(b).alias(a) for a, b in zip(words, more[1:], strict=True)]).agg(F.max("n").alias("to_left"))
            grams = grams.join(right.hint("merge"), words, "left").join(left.hint("merge"), words, "left")
            most = F.greatest(F.coalesce("to_right", F.lit(0)), F.coalesce("to_left", F.lit(0)))
        else:
            most = F.lit(0)
        grams = stage(grams.select(*words, "n", "lefts", "rights", most.cast("bigint").alias("longer")), f"grams-of-{size}")
        prefix = grams.select(*words, F.col("n").alias("part"), F.col("lefts").alias("parts"))
        suffix = grams.select(*words, F.col("n").alias("part"), F.col("rights").alias("parts"))
        padded = grams.select(
            *[F.col(g) if g in words else F.lit(0).cast("bigint").alias(g) for g in GRAM], "n", F.lit(size).alias("size"), "lefts", "rights", "longer"
        )
        found = padded if found is None else found.unionByName(padded)
    return found


def _scored(grams: DataFrame, scale: int, cover: tuple[int, int]) -> DataFrame:
    """(w1..w4, size, a, l, r, score) of the grams that no longer one covers, by their lowest-scoring cut."""
    wide = "decimal(20,0)"
    cut = F.expr(f"""
        array_min(transform(sequence(1, size - 1), k -> struct(
            (cast(n as {wide}) * {scale}BD) div (cast(lefts[k - 1] as {wide}) + cast(rights[k - 1] as {wide})) as score,
            k as k, lefts[k - 1] as l, rights[k - 1] as r)))
    """)
    covered = F.col("longer").cast(wide) * cover[1] >= F.col("n").cast(wide) * cover[0]
    kept = grams.where(~((F.col("longer") > 0) & covered)).withColumn("cut", cut)
    return kept.select(*GRAM, "size", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, scale: int = SCALE, cover: tuple[int, int] = COVER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `best` phrases of two to four words of each lang of docs (lang, text).

    n counts a lang's words, a the phrase's occurrences inside pieces (texts are cut at . , ; : ! ? and line
    ends), l and r those of the two parts at the cut with the least score, floor(scale * a / (l + r)) (ties: the
    earlier cut). Phrases with fewer than `least` occurrences are no candidates; one that a longer candidate
    holds with 80 % of its occurrences is dropped (a candidate of one word more then has as many, so only those
    are looked at). Ranked by score, a (both descending) and phrase (UTF-8 bytes).

    A null lang is `und`; null and empty texts have no words; repeated rows count each. Other columns are not
    read. No rows in, no rows out; neither without candidates.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    words, seed = vocabulary(docs)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = stage(words.where(F.col("n") >= least), "frequent-words")
    one = bitmap_of(frequent.select(F.col("id").alias("key")), frequent.count())
    pairs = gram_counts(docs, seed, pair_grams, one, least)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = _mixed(batch.column(0).to_numpy(), batch.column(1).to_numpy()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both)], ["key"])

    two = bitmap_of(pairs.select("w1", "w2").mapInArrow(key, "key bigint"), pairs.count())
    runs = gram_counts(docs, seed, long_grams, two, least)
    streams = {
        1: frequent.select(F.col("id").alias("w1"), "n"), 2: pairs.select("w1", "w2", "n"),
        3: runs.where("w4 = 0").select("w1", "w2", "w3", "n"), 4: runs.where("w4 != 0").select("w1", "w2", "w3", "w4", "n"),
    }
    scored = _scored(_parts(streams), scale, cover)
    langs = frequent.select(F.col("id").alias("w1"), "lang")
    # Ties in score and count are all kept until their words are known. The rank is cut in each task first.
    tied = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    top = stage(scored.join(langs, "w1").withColumn("tie", F.rank().over(tied)).where(F.col("tie") <= best), "best-phrases")
    for i, gram in enumerate(GRAM):
        known = frequent.select(F.col("id").alias(gram), F.col("word").alias(f"t{i}"))
        top = top.join(known, gram, "left")
    phrase = F.concat_ws(" ", *[f"t{i}" for i in range(LONGEST)])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = top.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
