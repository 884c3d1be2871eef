"""The three jobs end to end, each step a written table the next one reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import crawlers, linkage, matrix, mining, rules, search, sessions, tree
from tidemark.session import prepare
from tidemark.sources import logs, matrices, metadata, tables

CLICK_RANK, METADATA_RANK = 100, 300


def preprocess(
    spark: SparkSession, http_path: str, ftp_path: str, out: str, site: str,
    months: Sequence[str] | None = None, rate: int = crawlers.DEFAULT_RATE, gap: int = sessions.DEFAULT_GAP,
) -> None:
    """Raw log files to ``parsed``, ``sessions`` (request rows) and ``stats`` tables, one folder per month.

    All months run in one job; ``months`` prunes them. A month can be rerun alone: only its folders change.
    """
    prepare(spark)
    http = logs.scan_http(logs.read_lines(spark, http_path))
    ftp = logs.scan_ftp(logs.read_lines(spark, ftp_path))
    parsed = http.unionByName(ftp)
    if months is not None:
        parsed = parsed.where(F.col("month").isin(*months))
    tables.replace_months(parsed, f"{out}/parsed", months)
    clean = crawlers.remove_crawlers(tables.read_months(spark, f"{out}/parsed", months, parsed.schema), site, rate)
    found = sessions.combine_short_sessions(sessions.sessions_by_referer(clean, site, gap), gap)
    tables.replace_months(found, f"{out}/sessions", months)
    stats = sessions.session_statistics(tables.read_months(spark, f"{out}/sessions", months, found.schema))
    tables.replace_months(stats, f"{out}/stats", months)


def similarity(weights: DataFrame, rank: int, model: str) -> DataFrame:
    """Term pairs of a model from tf-idf weights: embed, compare, keep what is positive at two decimals."""
    pairs = matrix.positive_pairs(matrix.row_cosine(matrix.svd_embedding(weights, rank)), matrix.ZERO)
    return pairs.withColumn("model", F.lit(model))


def mine(
    spark: SparkSession, out: str, metadata_path: str, ontology_path: str, site: str,
    min_sessions: int = 5, min_users: int = 5,
) -> None:
    """Session tables, metadata and ontology files to nodes, clicks, pairs, rules and ``term_pairs``."""
    prepare(spark)
    log = tables.read_months(spark, f"{out}/sessions")
    nodes = tree.session_tree(sessions.valid_session_rows(log), site)
    tables.replace_months(nodes, f"{out}/nodes")
    nodes = tables.read_months(spark, f"{out}/nodes", schema=nodes.schema)
    clicks, filters = mining.click_through(nodes), mining.query_filter_pairs(nodes)
    tables.replace_months(clicks, f"{out}/clicks")
    tables.replace_months(mining.keyword_pairs(nodes), f"{out}/keyword_pairs")
    tables.replace_months(filters, f"{out}/filter_pairs")
    found = rules.association_rules(tables.read_months(spark, f"{out}/filter_pairs", schema=filters.schema))
    found.write.mode("overwrite").parquet(f"{out}/filter_rules")

    stats = tables.read_months(spark, f"{out}/stats")
    keywords = stats.select("ip", F.concat("month", F.lit("/"), "session_id").alias("session_id"), F.explode("keywords").alias("keyword"))
    history = mining.user_term_matrix(keywords, min_sessions=min_sessions, min_users=min_users)
    history_pairs = matrix.positive_pairs(matrix.row_cosine(history)).withColumn("model", F.lit("userHistory"))
    tables.write_term_pairs(history_pairs, f"{out}/term_pairs", ["userHistory"])

    clicks = tables.read_months(spark, f"{out}/clicks", schema=clicks.schema).select(F.col("keyword").alias("term"), F.col("dataset").alias("doc"))
    click_weights = matrix.tfidf(matrix.term_counts(clicks))
    tables.write_term_pairs(similarity(click_weights, CLICK_RANK, "userClicking"), f"{out}/term_pairs", ["userClicking"])

    records = metadata.read_json(spark, metadata_path)
    records.write.mode("overwrite").parquet(f"{out}/metadata")
    described = records.select(F.col("short_name").alias("doc"), F.explode(metadata.all_terms(records)).alias("term"))
    metadata_weights = matrix.tfidf(matrix.term_counts(described.withColumn("term", linkage.normalise(F.col("term")))))
    tables.write_term_pairs(similarity(metadata_weights, METADATA_RANK, "GCMDMetadata"), f"{out}/term_pairs", ["GCMDMetadata"])

    matrices.read_triples(spark, ontology_path).write.mode("overwrite").parquet(f"{out}/ontology")
    search.suggestions(keywords.select("keyword")).write.mode("overwrite").parquet(f"{out}/suggestions")
    texts = records.select(
        F.col("short_name").alias("doc"),
        F.concat_ws(" ", "short_name", "long_name", "keyword", "term", "topic", "variable", "abstract").alias("text"),
    )
    search.postings(texts).write.mode("overwrite").parquet(f"{out}/postings")


def answer(spark: SparkSession, out: str, inputs: DataFrame) -> DataFrame:
    """Semantic search of a table of inputs (input): expand with the fused vocabulary, match, rank."""
    prepare(spark)
    related = linkage.related_terms(inputs, spark.read.parquet(f"{out}/term_pairs"), spark.read.parquet(f"{out}/ontology"))
    groups = linkage.query_groups(inputs, linkage.fuse_terms(related))
    hits = search.search_metadata(groups, spark.read.parquet(f"{out}/postings"))
    records = spark.read.parquet(f"{out}/metadata").withColumnRenamed("short_name", "doc").withColumn("short_name", F.col("doc"))
    return search.result_json(hits, records)
