"""What sessions say: click-throughs, keyword pairs, query-filter pairs and user-term matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import filter_info, search_info, search_word
from tidemark.operators.ancestry import searches_above
from tidemark.operators.sessions import SESSION
from tidemark.operators.tree import view_nodes
from tidemark.session import stage

# Filter dimensions that never stand on the left side of a pair.
RIGHT_ONLY_DIMENSIONS = (
    "processinglevel", "gridspatialresolution", "temporalresolution", "timespan", "temporalsearch",
    "satellitespatialresolution",
)


def click_through(nodes: DataFrame) -> DataFrame:
    """Dataset views reached from a search page, one row per keyword of the view's own query."""
    views = view_nodes(nodes).where(F.col("parent_key") == "datasetlist")
    return views.select(
        *SESSION,
        F.explode(search_info(F.col("request"))).alias("keyword"),
        F.col("dataset_id").alias("dataset"),
        "downloaded",
    )


def keyword_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of searches that led to one downloaded view, weighted 1/(k+1) by the nearer one's rank.

    The searches above the views are rows (`ancestry`), paired by view; no list of them is built. Nodes are staged,
    since the paths read them more than once.
    """
    nodes = stage(nodes.select(*SESSION, "seq", "parent_seq", "key", "request", "downloaded"), "tree-nodes")
    views = view_nodes(nodes).where("downloaded").select(*SESSION, "seq", F.col("request").alias("view_url"))
    text = F.array_join(search_info(F.col("search_url")), "|")
    above = stage(searches_above(nodes, views).select(*SESSION, "seq", "k", text.alias("text")), "searches-above")
    near = above.withColumnsRenamed({"k": "near", "text": "keyword_b"})
    far = above.withColumnsRenamed({"k": "far", "text": "keyword_a"})
    pairs = near.join(far, [*SESSION, "seq"]).where((F.col("near") < F.col("far")) & (F.col("keyword_a") != F.col("keyword_b")))
    return pairs.join(views, [*SESSION, "seq"]).select(
        *SESSION, "view_url", "keyword_a", "keyword_b", (1.0 / (F.col("near") + 1)).alias("weight")
    )


def _dimension_text(pairs: Column) -> Column:
    """``dim:value,`` of every pair."""
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(p["key"], F.lit(":"), p["value"], F.lit(","))), ""
    )


def _pairs_of(left: Column, filters: Column) -> Column:
    """Rows for one left side: each filter alone (type 0) and all of them together (type 1)."""
    single = F.transform(
        F.filter(filters, lambda p: p["value"] != left),
        lambda p: F.struct(
            left.alias("query_a"), F.concat(p["key"], F.lit(":"), p["value"]).alias("filter_b"),
            F.lit(0).alias("type"),
        ),
    )
    combo = F.struct(left.alias("query_a"), _dimension_text(filters).alias("filter_b"), F.lit(1).alias("type"))
    return F.array_append(single, combo)


def query_filter_pairs(nodes: DataFrame) -> DataFrame:
    """For each view, its nearest search's text and filter values against that search's filters."""
    views = view_nodes(nodes).where(F.col("search_url").isNotNull())
    search = views.select(
        *SESSION, F.col("request").alias("view_url"), "search_url"
    )
    parsed = search.select(
        "*", search_word(F.col("search_url")).alias("word"), filter_info(F.col("search_url")).alias("all")
    ).where(F.size("all") > 0)
    parsed = parsed.withColumn("given", F.filter("all", lambda p: p["value"] != ""))
    by_word = F.when(F.col("word") != "", _pairs_of(F.col("word"), F.col("given"))).otherwise(
        F.array().cast("array<struct<query_a:string,filter_b:string,type:int>>")
    )

    def by_value(own: Column) -> Column:
        others = F.filter("given", lambda p: p["key"] != own["key"])
        single = F.transform(
            others,
            lambda p: F.struct(
                own["value"].alias("query_a"),
                F.concat(p["key"], F.lit(":"), p["value"]).alias("filter_b"), F.lit(0).alias("type"),
            ),
        )
        combo = F.struct(
            own["value"].alias("query_a"), _dimension_text(others).alias("filter_b"), F.lit(1).alias("type")
        )
        return F.array_append(single, combo)

    left = F.filter("given", lambda p: ~p["key"].isin(*RIGHT_ONLY_DIMENSIONS))
    rows = F.concat(by_word, F.flatten(F.transform(left, by_value)))
    return parsed.select(
        *SESSION, "search_url", "view_url", F.inline(rows)
    ).withColumn("weight", F.lit(1.0))


# --- users and terms -------------------------------------------------------------------------------


def keyword_visitors(session_keywords: DataFrame) -> DataFrame:
    """Sessions per keyword and visitor from rows (ip, session_id, keyword)."""
    return session_keywords.groupBy("keyword", "ip").agg(
        F.count_distinct("session_id").alias("sessions")
    )


def supported(
    session_keywords: DataFrame, min_sessions: int = 5, min_users: int = 5
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keyword x visitor counts, visitors with more sessions, terms with more visitors) than the minimum."""
    counts = stage(keyword_visitors(session_keywords), "keyword-visitors")
    users = (
        session_keywords.groupBy("ip").agg(F.count_distinct("session_id").alias("n"))
        .where(F.col("n") > min_sessions).select("ip")
    )
    terms = (
        counts.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > min_users).select("keyword")
    )
    return counts, users, terms


def user_term_matrix(
    session_keywords: DataFrame, tfidf: bool = False, min_sessions: int = 5, min_users: int = 5
) -> DataFrame:
    """Long matrix (term, feature = visitor, weight): 1, or sqrt(tf) * (1 + log10(N / (df + 1))).

    tf counts the visitor's sessions with the term, N all terms, df the visitor's distinct terms.
    """
    counts, users, terms = supported(session_keywords, min_sessions, min_users)
    kept = counts.join(users, "ip", "left_semi").join(terms, "keyword", "left_semi")
    if not tfidf:
        return kept.select(
            F.col("keyword").alias("term"), F.col("ip").alias("feature"), F.lit(1.0).alias("weight")
        )
    per_user = counts.groupBy("ip").agg(F.count(F.lit(1)).alias("df"))
    n_terms = counts.agg(F.count_distinct("keyword")).scalar()
    idf = 1 + F.log10(n_terms / (F.col("df") + 1))
    return kept.join(per_user, "ip").select(
        F.col("keyword").alias("term"), F.col("ip").alias("feature"),
        (F.sqrt("sessions") * idf).alias("weight"),
    )


def dataset_keywords(clicks: DataFrame) -> DataFrame:
    """Keywords of every dataset with their click counts (stays exploded; a hot dataset pre-aggregates)."""
    return clicks.groupBy("dataset", "keyword").agg(F.count(F.lit(1)).alias("n"))


def with_dataset_keywords(clicks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Click rows with the keyword list of the viewed dataset; null when the dataset is unknown."""
    return clicks.join(metadata.select("dataset", "keyword_list"), "dataset", "left")
