"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r (expected copies). Among all rates that give each source its target of words,
those nearest to 1 in relative entropy are r = min(cap, exp(tilt * size / mean size)), with one tilt for
each source: the multiplier of its constraint in the convex dual. Newton's method finds the tilts; a step
needs two sums for each source over all documents. The rates are then rounded into copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.rows import fresh, with_row_number
from tidemark.operators.matrix import dense_ids
from tidemark.session import stage, stage_result

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3
STEPS = 60  # most Newton steps; they end when every source is near
ASK = 4  # steps between two questions whether all sources are done; further steps leave those alone
NEAR = 1e-6  # of the target
BUCKETS = 1024  # runs of the drawing order whose sizes are summed apart
PASSES = 5  # times that what a source still lacks is filled with further documents


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(id, source, source_size, n, target) from (source, source_size, n), one row for each source.

    Sources in code-point order, null last, weigh `weights` in turn and share the total; no target is above
    cap times its source's size, and the excess goes to the others by weight until none is above. That is
    the level c with sum of min(cap * size, weight * c) = total: in the order of cap * size / weight, sources
    are capped as long as that is under the level that the rest would get. The windows see one row of each
    source, never documents.
    """
    named = stage(sizes, "source-sizes")
    numbered = dense_ids(named.where("source is not null"), "source")
    ranked = named.join(numbered, "source", "left").withColumn(
        "id", F.coalesce("id", F.count("source").over(Window.partitionBy()))
    )
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("id") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("top", cap * F.col("source_size"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("top") / F.col("weight"), "id")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(before), F.lit(0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = ranked.withColumn("left", left).withColumn("share", share)
    fits = F.col("top") * F.col("share") >= F.col("left") * F.col("weight")
    level = level.withColumn("level", F.first(F.when(fits, F.col("left") / F.col("share")), True).over(whole))
    target = F.least(F.col("top").cast("double"), F.col("weight") * F.coalesce("level", F.lit(0.0)))
    return level.select("id", "source", "source_size", "n", target.alias("target"))


def tilts(histogram: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """(id, tilt, mean) for each source: Newton's method on the dual, for all sources at once.

    `histogram` is (id, size, n): how many documents of a source have a size, all that a step needs. The
    words given grow with the tilt, with the derivative of the sum over documents under the cap; a step is
    kept inside the bracket of earlier values and halves it where it would leave. A source whose target is
    its most (cap times its size) gets an infinite tilt, one without words 0.
    """
    mean = F.col("source_size") / F.col("n")
    state = targets.select(
        "id", "target", mean.alias("mean"),
        F.when(F.col("source_size") == 0, 0.0).when(F.col("target") >= cap * F.col("source_size"), float("inf"))
        .otherwise(F.log(F.try_divide(F.greatest(F.col("target"), F.lit(1e-9)), F.col("source_size")))).alias("tilt"),
        F.lit(-745.0).alias("low"), F.lit(745.0).alias("high"),
    ).withColumn("done", (F.col("tilt") == float("inf")) | (F.col("target") <= 0) | (F.col("mean") == 0))
    state = stage(state, "tilts")
    for step in range(STEPS):
        if step % ASK == 0 and state.where("not done").isEmpty():
            break
        x = F.col("size") / F.col("mean")
        free = F.exp(F.least(F.col("tilt") * x, F.lit(700.0)))
        words = F.col("n") * F.col("size") * F.least(F.lit(float(cap)), free)
        slope = F.when(free < cap, words * x).otherwise(0.0)
        sums = (
            histogram.join(state.where("not done").select("id", "tilt", "mean"), "id")
            .groupBy("id").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        )
        gap = F.col("words") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(gap, F.col("slope"))
        middle = (F.col("low") + F.col("high")) / 2
        state = (
            state.join(sums, "id", "left").withColumn("low", F.coalesce(F.when(F.col("done"), F.col("low")).otherwise(low), "low"))
            .withColumn("high", F.when(F.col("done"), F.col("high")).otherwise(high))
            .withColumn("done", F.col("done") | (F.abs(gap) <= NEAR * F.col("target")) | (F.col("high") - F.col("low") < 1e-12))
            .withColumn("tilt", F.when(F.col("done"), F.col("tilt")).when(
                (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle))
            .select("id", "target", "mean", "tilt", "low", "high", "done")
        )
        state = stage(state, "tilts")
    return state.select("id", "tilt", "mean")


def _fill(pool: DataFrame, lacks: DataFrame, last: bool) -> DataFrame:
    """(row, id, size, draw, taken) of the rows of `pool` that may still be of use; staged.

    Taken are the documents that come first in the drawing order of their source and together fill what it
    lacks. Sizes are summed over `BUCKETS` runs of the order first, so that only the run in which a source gets
    full is looked at row by row. A row that would overfill is left; the last time it is taken if that comes
    nearer to the target. Rows of twice what is lacking are of no use any more, as lacks only shrink.
    """
    near = pool.join(lacks, "id").where("size < 2 * lack")
    near = near.withColumn("run", F.least(F.floor(F.col("draw") * BUCKETS), F.lit(4 * BUCKETS)))
    fits = F.lit(True) if last else F.col("size") <= F.col("lack")
    near = near.withColumn("fits", fits)
    runs = near.where("fits").groupBy("id", "run").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    placed = near.join(runs, ["id", "run"], "left")
    edge = F.coalesce(F.col("fits") & (F.col("before") < F.col("lack")) & (F.col("before") + F.col("words") > F.col("lack")), F.lit(False))
    order = Window.partitionBy("id", "run").orderBy("draw", "row").rowsBetween(Window.unboundedPreceding, 0)
    cut = placed.where(edge).withColumn("upto", F.col("before") + F.sum("size").over(order))
    nearest = F.expr("upto - lack <= lack - (upto - size)" if last else "upto <= lack")
    whole = F.col("fits") & (F.col("before") + F.col("words") <= F.col("lack"))
    columns = ["row", "id", "size", "draw"]
    rest = placed.where(~edge).select(*columns, F.coalesce(whole, F.lit(False)).alias("taken"))
    return stage(rest.unionByName(cut.select(*columns, nearest.alias("taken"))), "fill")


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 42
) -> DataFrame:
    """(row, doc_id, size, source_size, target, rate, copies, taken) of every row of docs (doc_id, text, source).

    A document's copies are the whole part of its rate and, for the fractional part f, one more with
    probability near f: in each source documents are drawn in the order of u / f, u a hash of the row's
    values, until the source has its target. Then, `PASSES` times in all, what it still lacks is filled with
    further documents that fit. So a source's words miss its target by less than half of one of its small
    documents where it has any; copies never exceed `cap`. Equal input gives equal output: the draw is a
    hash of the document, ties go by row number.

    Null and blank texts have size 0 and 0 copies taken count as 0 words. A null source is a source of its
    own, the last. Repeated rows are documents each. Other columns of docs are not read.
    """
    key = fresh(docs, "row")
    plain = with_row_number(docs, key).select(F.col(key).alias("row"), "doc_id", "source", "text")
    return mixed_rows(plain, weights, cap, seed)


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 42) -> DataFrame:
    """`mixed` of rows with a `row` number that is the same at every reading."""
    rows = stage(
        docs.select(
            "row", F.col("doc_id"), F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
        ),
        "sizes",
    )
    cells = stage(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-histogram")
    sources = stage(
        source_targets(
            cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n")),
            weights, cap,
        ),
        "targets",
    )
    by_source = sources.select("id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("key"))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    histogram = stage(cells.withColumn("key", key).join(by_source, "key").select("id", "size", "n"), "histogram")
    solved = tilts(histogram, sources, cap).join(sources.select("id", "source", "source_size", "target"), "id")
    solved = stage(solved.withColumn("key", key).drop("source"), "solved")
    # A rate depends on source and size alone, so it is worked out once for each of these and met by hash.
    rate = F.when(F.col("tilt") == float("inf"), F.lit(float(cap))).otherwise(
        F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size") / F.greatest(F.col("mean"), F.lit(1e-9)), F.lit(700.0))))
    )
    unit = (F.xxhash64(F.lit(seed), "doc_id", "key", "size").cast("double") / 2.0**64 + 0.5)
    rated = stage(
        rows.withColumn("key", key).join(solved, "key").withColumn("rate", rate)
        .withColumn("whole", F.floor("rate").cast("bigint"))
        .withColumn("part", F.col("rate") - F.col("whole"))
        .withColumn("draw", F.coalesce(F.least(F.try_divide(unit, F.col("part")), F.lit(1e9)), F.lit(2e9)))
        .select("row", "doc_id", "id", "size", "source_size", "target", "rate", "whole", "draw"),
        "rates",
    )
    pool = rated.where("size > 0 and whole < %d" % cap).select("row", "id", "size", "draw")
    lacks = stage(rated.groupBy("id").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("lack")), "lacks")
    extra = None
    for turn in range(PASSES):
        seen = _fill(pool, lacks, turn == PASSES - 1)
        found, pool = seen.where("taken"), seen.where("not taken").drop("taken")
        if turn < PASSES - 1:
            given = found.groupBy("id").agg(F.sum("size").alias("given"))
            lacks = stage(lacks.join(given, "id", "left").select("id", (F.col("lack") - F.coalesce("given", F.lit(0))).alias("lack")), "lacks")
        extra = found.select("row") if extra is None else extra.unionByName(found.select("row"))
    copies = (F.col("whole") + F.coalesce("more", F.lit(0))).cast("bigint")
    return rated.join(extra.withColumn("more", F.lit(1)), "row", "left").withColumn("copies", copies).select(
        "row", "doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of docs in as many copies as the mix takes, with their columns.

    Copies meet texts by the row's number in the files, so the tables may be read in any number of tasks.
    Documents without words are kept once. Nulls, empty texts and repeated rows as in `mixed`; no rows in, no
    rows out. Columns of any name stay.
    """
    row, times, copy = fresh(docs, "_row"), fresh(docs, "_copies"), fresh(docs, "_copy")
    numbered = with_row_number(docs, row)
    plain = numbered.select(F.col(row).alias("row"), "doc_id", "source", "text")
    copies = stage_result(docs.sparkSession, lambda: mixed_rows(plain, weights, cap).where("copies > 0 or size = 0").select(
        F.col("row").alias(row), F.greatest("copies", (F.col("size") == 0).cast("bigint")).alias(times)
    ), "copies")
    each = F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))
    return numbered.join(copies.hint("merge"), row).withColumn(copy, each).select(*docs.columns)
