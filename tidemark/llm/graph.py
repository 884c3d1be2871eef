"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage


def _is_forest_of_stars(links: DataFrame) -> bool:
    """True when every node has one link only and that leads to a node without one."""
    end = lambda c, out: F.struct(F.col(c).alias("node"), F.lit(out).alias("out"))
    ends = links.select(F.inline(F.array(end("u", 1), end("v", 0)))).groupBy("node").agg(F.sum("out").alias("n"), F.min("out").alias("least"))
    return ends.where("n > 1 or n > 0 and least = 0").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has a link: root is the smallest node reachable.

    Each round hooks the neighbours of a node to the smallest of them (first the larger ones, then the
    smaller ones); the links shrink to stars in O(log^2 n) rounds. A round is two joins on a node with its
    minimum, which the adaptive planner splits for hot nodes; no neighbourhood is ever collected. Rounds
    are written to the checkpoint folder, so a lost executor re-reads files. An empty table gives no rows.
    """
    links = stage(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    while not _is_forest_of_stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u and v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("l")
        )
        links = stage(small.select("l.u", "l.v").where("u != v").distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
