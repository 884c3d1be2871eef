"""Ranked metadata search over postings, and fuzzy completion of typed prefixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import round2
from tidemark.functions.text import content_tokens, stem_all
from tidemark.operators.matrix import dense_ids, stemmed_counts
from tidemark.session import stage

K1, B = 1.2, 0.75
BLOCK_DOCS = 256  # documents of a block of the ranked search
MARGIN = 1e-6  # above what rounding to eight places and the order of a sum can change


def postings(texts: DataFrame) -> DataFrame:
    """(term, doc, tf) of (doc, text)."""
    return stemmed_counts(texts)


def query_terms(groups: DataFrame) -> DataFrame:
    """(input, part, term, n_terms) of (input, part, phrase): the stems a document must all contain."""
    stems = F.array_distinct(stem_all(content_tokens(F.col("phrase"))))
    return groups.withColumn("_s", stems).select(
        "input", "part", F.explode("_s").alias("term"), F.size("_s").alias("n_terms")
    )


def impact_postings(index: DataFrame, terms: DataFrame | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(term, block, doc, impact) of a postings table: the BM25 share of each posting and its document's block.

    Documents are numbered by length, so a block holds ``block_docs`` of like length and the highest impact of a
    stem in it is close to the others. With ``terms`` only their postings are kept; without, the table serves any
    query and is best written once. Rows without a document are left out.
    """
    totals = stage(index.where("doc is not null").groupBy("doc").agg(F.sum("tf").alias("length")), "document-lengths")
    sizes = totals.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    numbered = dense_ids(totals.select(F.struct("length", "doc").alias("place")), "place")
    placed = numbered.select("place.doc", "place.length", F.floor(F.col("id") / block_docs).alias("block"))
    kept = index if terms is None else index.join(terms.select("term").distinct(), "term", "left_semi")
    spread = kept.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (sizes["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    shape = F.col("tf") + K1 * (1 - B + B * F.col("length") / sizes["mean"])
    return kept.join(placed, "doc").join(spread, "term").select(
        "term", "block", "doc", (idf * F.col("tf") * (K1 + 1) / shape).alias("impact")
    )


def block_bounds(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(input, block, bound, may): what a document of the block can score at most and how many may score at all.

    A part counts where the block has all its stems, with the sum of their highest impacts there. One row a stem
    and block meets the query, not its postings.
    """
    peaks = postings.groupBy("term", "block").agg(F.max("impact").alias("peak"), F.count(F.lit(1)).alias("n"))
    parts = terms.join(peaks, "term").groupBy("input", "part", "n_terms", "block").agg(
        F.count(F.lit(1)).alias("matched"), F.sum("peak").alias("bound"), F.min("n").alias("may")
    ).where(F.col("matched") == F.col("n_terms"))
    return parts.groupBy("input", "block").agg(F.sum("bound").alias("bound"), F.sum("may").alias("may"))


def first_cells(bounds: DataFrame, k: int) -> DataFrame:
    """(input, block): the blocks of highest bound that may hold 2 k hits together, at most k of them."""
    best = Window.partitionBy("input").orderBy(F.desc("bound"), "block")
    top = bounds.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
    before = F.coalesce(F.sum("may").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return top.withColumn("_before", before).where(F.col("_before") < 2 * k).select("input", "block")


def cell_hits(cells: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(input, doc, score) of the documents in the cells (input, block) that have all stems of some part.

    Postings are met by stem and block, so a frequent stem is spread over its blocks.
    """
    met = cells.join(terms, "input").join(postings, ["term", "block"])
    parts = met.groupBy("input", "part", "n_terms", "doc").agg(
        F.count(F.lit(1)).alias("matched"), F.sum("impact").alias("part_score")
    ).where(F.col("matched") == F.col("n_terms"))
    # Equal scores must tie whatever order their terms were summed in, so they are rounded first.
    return parts.groupBy("input", "doc").agg(F.round(F.sum("part_score"), 8).alias("score"))


def remaining_cells(bounds: DataFrame, done: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(input, block): the cells not done yet whose bound reaches the k-th score among the hits found so far.

    An input with fewer than k hits so far keeps all its cells. Bounds equal to the k-th score stay, since a tie
    goes to the smaller document; `MARGIN` covers rounding.
    """
    best = Window.partitionBy("input").orderBy(F.desc("score"), "doc")
    kth = hits.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).groupBy("input").agg(
        F.min("score").alias("_least"), F.count(F.lit(1)).alias("_found")
    ).where(F.col("_found") == k)
    open_cells = bounds.join(done, ["input", "block"], "left_anti").join(kth, "input", "left")
    return open_cells.where(F.col("_least").isNull() | (F.col("bound") + MARGIN >= F.col("_least"))).select("input", "block")


def scoring_rounds(terms: DataFrame, postings: DataFrame, k: int) -> list[tuple[DataFrame, DataFrame]]:
    """Three rounds of (cells, hits), each with the k-th score of those before it.

    First the blocks of highest bound that may hold 2 k hits, then what is left among the k blocks of highest bound
    (for one stem their peaks are scores, so the k-th score is final after it), then what is left of all. Cells and
    hits of a round are written, as the next ones read them.
    """
    bounds = stage(block_bounds(terms, postings), "block-bounds")
    best = Window.partitionBy("input").orderBy(F.desc("bound"), "block")
    high = bounds.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).drop("_rank")
    cells = stage(first_cells(bounds, k), "first-cells")
    rounds = [(cells, stage(cell_hits(cells, terms, postings), "first-hits"))]
    for among in (high, bounds):
        done = reduce(DataFrame.unionByName, [c for c, _ in rounds])
        hits = reduce(DataFrame.unionByName, [h for _, h in rounds])
        cells = stage(remaining_cells(among, done, hits, k), "cells-left")
        rounds.append((cells, stage(cell_hits(cells, terms, postings), "more-hits")))
    return rounds


def ranked_hits(terms: DataFrame, postings: DataFrame, k: int = 500) -> DataFrame:
    """(input, rank, doc, score): the k best documents of query terms over `impact_postings`; exact.

    The blocks of highest bound are scored first. What they yield gives each input a k-th score, and of the other
    blocks only those that can reach it are scored.
    """
    terms = terms.select("input", "part", "term", "n_terms")
    hits = reduce(DataFrame.unionByName, [h for _, h in scoring_rounds(terms, postings, k)])
    rank = F.row_number().over(Window.partitionBy("input").orderBy(F.desc("score"), "doc"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("input", "rank", "doc", "score")


def search_metadata(groups: DataFrame, index: DataFrame, k: int = 500, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(input, rank, doc, score, relevance): documents that contain all stems of some part of the query.

    A part scores the BM25 sum of its stems and a document the sum of its matching parts; relevance is
    the percentage of the query's best score. ``index`` is a postings table, best written once and read
    back, or `impact_postings` of one. Blocks of documents that cannot reach the first ``k`` are not scored.
    """
    terms = stage(query_terms(groups), "query-terms")  # few beside the postings, which are then not shuffled to be met
    if "impact" not in index.columns:
        index = stage(impact_postings(index, terms, block_docs), "impact-postings")
    top = ranked_hits(terms, index, k)
    best = F.max("score").over(Window.partitionBy("input"))
    return top.select(
        "input", "rank", "doc", "score", round2(F.col("score") / best * 100).alias("relevance")
    )


def result_json(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """(input, rank, record): each hit as a JSON object of relevance, names, keywords and abstract."""
    record = F.struct(
        F.format_string("%.2f%%", "relevance").alias("Relevance"),
        F.col("short_name").alias("Short Name"), F.col("long_name").alias("Long Name"),
        F.col("keyword").alias("Keyword"), F.col("abstract").alias("Abstract"),
    )
    return hits.join(metadata, "doc").select("input", "rank", F.to_json(record).alias("record"))


def suggestions(session_keywords: DataFrame) -> DataFrame:
    """(term, n) of every session keyword."""
    return session_keywords.groupBy(F.col("keyword").alias("term")).agg(F.count(F.lit(1)).alias("n"))


# Fixed values of fuzzy completion: edits allowed, exact leading characters, shortest fuzzy input.
MAX_EDITS, EXACT_PREFIX, MIN_FUZZY_LENGTH = 2, 1, 3
KEY_LENGTH = 5  # characters after the exact prefix that keys are cut from


def _without_one(text: Column) -> Column:
    """The text without each of its characters in turn."""
    at = F.sequence(F.lit(1), F.length(text))
    rest = lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))
    return F.when(F.length(text) > 0, F.transform(at, rest)).otherwise(F.array().cast("array<string>"))


def _neighbourhood(texts: Column) -> Column:
    """What is left of any of the texts after up to `MAX_EDITS` deletions, one to `KEY_LENGTH` characters long."""
    found, last = texts, texts
    for _ in range(MAX_EDITS):
        last = F.array_distinct(F.flatten(F.transform(last, _without_one)))
        found = F.concat(found, last)
    return F.filter(F.array_distinct(found), lambda x: F.length(x).between(1, KEY_LENGTH))


def completion_index(terms: DataFrame) -> DataFrame:
    """(first, key, term, n) of terms (term, n): some 55 keys a term, best written once and read back.

    The keys are what is left of the term's beginnings (after its first character) without up to two of their
    characters.
    """
    rest = F.substring("term", F.lit(EXACT_PREFIX + 1), F.lit(KEY_LENGTH + MAX_EDITS))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(KEY_LENGTH + MAX_EDITS)), lambda j: F.left(rest, j)))
    return terms.where(F.length("term") >= EXACT_PREFIX).select(
        F.left("term", F.lit(EXACT_PREFIX)).alias("first"), F.explode(_neighbourhood(starts)).alias("key"), "term", "n"
    )


def completion_candidates(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(prefix, size, term, n): the terms that share a key with an input (prefix, size)."""
    start = F.array(F.substring("prefix", F.lit(EXACT_PREFIX + 1), F.lit(KEY_LENGTH)))
    keys = asked.select(
        "prefix", "size", F.left("prefix", F.lit(EXACT_PREFIX)).alias("first"), F.explode(_neighbourhood(start)).alias("key")
    )
    return keys.join(index, ["first", "key"]).select("prefix", "size", "term", "n").distinct()


def complete(prefixes: DataFrame, terms: DataFrame, k: int = 10, index: DataFrame | None = None) -> DataFrame:
    """(prefix, rank, term): the k most used terms that start like each prefix, two edits allowed.

    The first character must agree; inputs under three characters match exactly. Two texts at most two
    edits apart have a common rest after up to two deletions in each, and so have their beginnings. So longer
    inputs meet terms in an equi-join on such rests of their first characters (`completion_index` of the
    terms, worked out here unless given), and those candidates are checked by edit distance. An input of three
    characters is within two edits of every term with its first character: of those only the k most used
    are met. No pair of the two tables is formed otherwise.
    """
    asked = prefixes.select(F.lower("prefix").alias("prefix")).distinct().withColumn(
        "size", F.length("prefix")
    )
    exact = asked.where(F.col("size").between(1, MIN_FUZZY_LENGTH - 1))
    short = terms.select(
        "term", "n", F.explode(F.sequence(F.lit(1), F.lit(MIN_FUZZY_LENGTH - 1))).alias("size")
    ).withColumn("prefix", F.substring("term", F.lit(1), F.col("size")))
    exact_hits = exact.join(short, ["prefix", "size"]).select("prefix", "term", "n")

    by_use = Window.partitionBy("first").orderBy(F.desc("n"), "term")
    used = terms.where(F.length("term") >= EXACT_PREFIX).withColumn("first", F.left("term", F.lit(EXACT_PREFIX)))
    used = used.withColumn("_rank", F.row_number().over(by_use)).where(F.col("_rank") <= k)
    all_near = asked.where(F.col("size") == EXACT_PREFIX + MAX_EDITS).withColumn("first", F.left("prefix", F.lit(EXACT_PREFIX)))
    near_hits = all_near.join(used, "first").select("prefix", "term", "n")

    index = completion_index(terms) if index is None else index
    candidates = completion_candidates(asked.where(F.col("size") > EXACT_PREFIX + MAX_EDITS), index)
    close = F.exists(
        F.sequence(F.greatest(F.col("size") - MAX_EDITS, F.lit(1)), F.col("size") + MAX_EDITS),
        lambda length: F.levenshtein(F.left("term", length), F.col("prefix"), MAX_EDITS) >= 0,
    )
    hits = exact_hits.unionByName(near_hits).unionByName(candidates.where(close).select("prefix", "term", "n"))
    w = Window.partitionBy("prefix").orderBy(F.desc("n"), "term")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("prefix", "rank", "term")
