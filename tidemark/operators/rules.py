"""Association rules between queries and filters, and filter recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage


def association_rules(pairs: DataFrame) -> DataFrame:
    """Rules A -> B of (query_a, filter_b, weight, type): confidence = sum w(A,B) / sum w(A).

    Of a rule and its reverse only the one met first is kept; left sides are visited by falling row
    count, then by name. Pair sums are built first, so a left side with a third of all rows is small
    by the time it is grouped again.
    """
    grouped = pairs.groupBy("query_a", "filter_b", "type").agg(
        F.sum("weight").alias("count"), F.count(F.lit(1)).alias("_rows")
    )
    sums = stage(grouped, "pair-sums")
    left = sums.groupBy("query_a", "type").agg(F.sum("count").alias("support_a"))
    order = sums.groupBy("query_a").agg(F.sum("_rows").alias("_rows_a"))
    rated = (
        sums.drop("_rows").join(left, ["query_a", "type"]).join(order, "query_a")
        .withColumn("confidence", F.col("count") / F.col("support_a"))
        .withColumn("_low", F.least("query_a", "filter_b"))
        .withColumn("_high", F.greatest("query_a", "filter_b"))
    )
    columns = ["query_a", "filter_b", "support_a", "confidence", "count"]
    kept = F.min_by(F.struct(*columns), F.struct(-F.col("_rows_a"), F.col("query_a")))
    return rated.groupBy("_low", "_high", "type").agg(kept.alias("r")).select("r.*", "type")


def recommended_filters(rules: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Top filters by confidence (type 0) for each row of ``queries`` (query), as rows."""
    hits = rules.where(F.col("type") == 0).join(
        queries.select(F.col("query").alias("query_a")).distinct(), "query_a", "left_semi"
    )
    w = Window.partitionBy("query_a").orderBy(F.desc("confidence"), F.desc("filter_b"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        F.col("query_a").alias("query"), "rank", F.col("filter_b").alias("filter"), "confidence"
    )


def filters_json(recommended: DataFrame) -> DataFrame:
    """One ``{"filters":[{"filter":…,"weight":"…"}]}`` document per query, best first."""
    entry = F.struct(
        "rank",
        F.struct(F.col("filter"), F.col("confidence").cast("string").alias("weight")).alias("f"),
    )
    return recommended.groupBy("query").agg(F.array_sort(F.collect_list(entry)).alias("e")).select(
        "query", F.to_json(F.struct(F.transform("e", lambda x: x["f"]).alias("filters"))).alias("filters")
    )
