"""Benchmark decontamination by a prefix-filtered set join: documents whose words hold windows of benchmark items.

A window is `WINDOW` consecutive words of an item (all its words where it has fewer). As a set of shingles
(runs of `SHINGLE` words) it must be contained in the shingles of an equally long window of a document.
Full containment needs a prefix of one shingle: with shingles ordered by rarity in the documents, the rarest
one. So a document meets a window only at places that hold its rarest shingle. The place and the shingle's
offset say where the window would start; bounds on that start and on the document's length come before the
words themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
SENT = 500_000  # windows of about 200 bytes that may be sent to every task; more of them are joined by a shuffle


def words_of(text: Column) -> Column:
    """Words of the whole text after lower-casing A-Z; none for null."""
    cut = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), *LOWER), SEPARATORS, -1)
    return F.array_remove(cut, "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words): the distinct windows of each item; an item without words has none."""
    words = items.select(F.col("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    starts = words.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("start"))
    return starts.select("item_id", F.slice("words", F.col("start") + 1, window).alias("words")).distinct()


def _shingles(words: Column, k: int) -> Column:
    """Array of the k words from each place on, nulls where fewer are left."""
    return F.arrays_zip(*[F.slice(words, i + 1, F.greatest(F.size(words), F.lit(1))).alias(f"w{i}") for i in range(k)])


def _hash(shingle: str, k: int) -> Column:
    return F.xxhash64(*[F.col(f"{shingle}.w{i}") for i in range(k)])


def _window_shingles(windows: DataFrame, k: int) -> DataFrame:
    """(window, words, at, hash): every shingle of k words of the windows, `at` its offset."""
    placed = windows.select("window", "words", F.posexplode(_shingles(F.col("words"), k)).alias("at", "g"))
    return placed.where(F.col(f"g.w{k - 1}").isNotNull()).select("window", "words", "at", _hash("g", k).alias("hash"))


def _places(rows: DataFrame, k: int) -> DataFrame:
    """The rows once for each shingle of k words, with its place and hash; one row without a hash for shorter texts."""
    placed = rows.select("*", F.posexplode_outer(_shingles(F.col("words"), k)).alias("place", "g"))
    return placed.withColumn("place", F.coalesce("place", F.lit(0))).withColumn(
        "hash", F.when(F.col(f"g.w{k - 1}").isNotNull(), _hash("g", k))
    ).drop("g")


def _rarest(documents: DataFrame, windows: DataFrame, k: int, sent: bool) -> DataFrame:
    """(window, words, at, hash): the prefix of each window, the shingle that the fewest places of the documents hold.

    A window that has a shingle which no document holds is in none and has no row.
    """
    shingles = stage(_window_shingles(windows, k), "window-shingles")
    asked = shingles.select("hash").distinct()
    held = _places(documents.select("words"), k).select("hash").join(
        F.broadcast(asked) if sent else asked.hint("merge"), "hash", "left_semi"
    )
    counts = held.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "at")  # at most a window's shingles
    ranked = shingles.join(counts, "hash", "left").withColumn("rank", F.row_number().over(order))
    return stage(ranked.where("rank = 1 and n > 0").select("window", "words", "at", "hash"), "window-prefixes")


def _verified(met: DataFrame) -> DataFrame:
    """`met` with `start` and `length` of the window where its words stand there, nulls where they don't."""
    start, length = F.col("place") - F.col("at"), F.size("wanted")
    inside = F.col("at").isNotNull() & (start >= 0) & (start + length <= F.col("n_words"))
    same = F.when(inside, F.slice("words", F.greatest(start, F.lit(0)) + 1, length) == F.col("wanted")).otherwise(False)
    return met.withColumn("same", same).select(
        "row", "doc_id", "n_words", "place", F.when(F.col("same"), F.col("window")).alias("window"),
        F.when(F.col("same"), start).alias("start"), F.when(F.col("same"), length).alias("length"),
    )


def _met_by_sending(documents: DataFrame, prefixes: DataFrame, k: int) -> DataFrame:
    """Verified places and each row's first place; texts stay where they are, the prefixes are sent."""
    asked = F.broadcast(prefixes.withColumnRenamed("words", "wanted"))
    return _verified(_places(documents, k).join(asked, "hash", "left")).where("start is not null or place = 0")


def _met_by_shuffling(documents: DataFrame, prefixes: DataFrame, k: int) -> DataFrame:
    """The same where the windows are too many to be sent: (hash, row, place) is shuffled, and the words once a row."""
    places = _places(documents.select("row", "words"), k).select("row", "place", "hash").where("hash is not null")
    hits = places.join(prefixes.hint("merge"), "hash").select("row", "place", "at", "window", F.col("words").alias("wanted"))
    met = documents.join(hits.hint("merge"), "row", "left").withColumn("place", F.coalesce("place", F.lit(0)))
    first = documents.select("row", "doc_id", "n_words", F.lit(0).alias("place"), *[
        F.lit(None).cast(kind).alias(name) for name, kind in (("window", "bigint"), ("start", "int"), ("length", "int"))
    ])
    return _verified(met).where("start is not null").unionByName(first)


def window_hits(docs: DataFrame, windows: DataFrame, k: int = SHINGLE, most_sent: int = SENT) -> DataFrame:
    """(row, doc_id, n_words, window, start, length) of every place where a window occurs; `start` counts words from 0.

    `windows` is (window, words) with distinct words; `row` numbers the rows of docs. Each row also has
    places without a window, so that rows without any are kept. Windows shorter than k words are met by all their words.
    """
    windows = stage(windows, "windows").withColumn("k", F.least(F.size("words"), F.lit(k)))
    counted = {r["k"]: r["n"] for r in windows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most k rows
    sent = sum(counted.values()) <= most_sent
    documents = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
        words_of(F.col("text")).alias("words"),
    ).withColumn("n_words", F.size("words"))
    if not sent or len(counted) > 1:
        documents = stage(documents, "document-words")  # more than one table joins by the row number
    found = None
    for size in sorted(counted):
        prefixes = _rarest(documents, windows.where(F.col("k") == size).drop("k"), size, sent)
        part = (_met_by_sending if sent else _met_by_shuffling)(documents, prefixes, size)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = documents.select(
            "row", "doc_id", "n_words", F.lit(None).cast("bigint").alias("window"),
            F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"),
        )
    return stage(found.select("row", "doc_id", "n_words", "window", "start", "length"), "window-hits")


def _covered(spans: Column) -> Column:
    """Words covered by (start, length) spans: their union, walked in the order of starts. No more spans than words."""
    def step(seen: Column, span: Column) -> Column:
        stop = span["start"] + span["length"]
        return F.struct(
            (seen["n"] + F.greatest(F.lit(0), stop - F.greatest(span["start"], seen["stop"]))).alias("n"),
            F.greatest(seen["stop"], stop).alias("stop"),
        )

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")), step)["n"]


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = SHINGLE, most_sent: int = SENT) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs (doc_id, text).

    n_hit counts the words inside any occurrence of a window of `items` (item_id, text), n_items the items
    whose windows occur, items_sha256 is over their ids, as strings, sorted and comma-joined ('' for none).

    Null and empty texts have no words. Repeated rows are judged each; a null doc_id stays null. An item
    without words has no windows, rows of one item_id are one item, and the windows of an item without an id
    count as hits but not as an item. Other columns are not read. No documents, no rows; no items, no hits.
    """
    of_items = stage(item_windows(items, window), "item-windows")
    named = stage(
        of_items.select("words").distinct().withColumn("window", F.monotonically_increasing_id()),
        "distinct-windows",
    )
    hits = window_hits(docs, named, k, most_sent)
    covered = hits.where("window is not null").groupBy("row").agg(
        _covered(F.collect_set(F.struct("start", "length"))).cast("bigint").alias("n_hit")
    )
    owners = named.join(of_items.where("item_id is not null"), "words").select("window", F.col("item_id").cast("string").alias("item"))
    ids = F.array_sort(F.collect_set("item"))  # the items of one row, which the digest takes together
    found = (
        hits.where("window is not null").select("row", "window").distinct().join(owners, "window")
        .groupBy("row").agg(F.size(ids).cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    )
    rows = hits.select("row", "doc_id", F.col("n_words").cast("bigint").alias("n_words")).distinct()
    return rows.join(covered, "row", "left").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
