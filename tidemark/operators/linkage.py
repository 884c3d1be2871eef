"""Related terms from several models, fused into one weight; expansion, graph and evaluation report.

All functions answer a whole table of inputs at once. Relations: ``pairs`` (term_a, term_b, weight,
model) read from either side, ``ontology`` (concept_a, concept_b, weight) read from A to B.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import conjunction, round2
from tidemark.functions.text import normalise

# How much each model counts, and how many terms it may contribute.
MODEL_WEIGHTS = {"userHistory": 2, "userClicking": 2, "GCMDMetadata": 2, "SWEET": 1}
PAIR_LIMIT, ONTOLOGY_LIMIT = 20, 30
BONUS = 0.05

# Terms always included in the evaluation report.
REPORT_TERMS = (
    "sea surface height", "noaa 18", "grace", "seasat", "pathfinder", "ocean wave", "ghrsst",
    "sea ice", "avhrr 2", "jason 1 geodetic",
)


def directed(pairs: DataFrame) -> DataFrame:
    """Stored pairs seen from both ends."""
    forward = pairs.select(F.col("term_a").alias("known"), F.col("term_b").alias("term"), "weight", "model")
    backward = pairs.where(F.col("term_a") != F.col("term_b")).select(
        F.col("term_b").alias("known"), F.col("term_a").alias("term"), "weight", "model"
    )
    return forward.unionByName(backward)


def related_terms(inputs: DataFrame, pairs: DataFrame, ontology: DataFrame) -> DataFrame:
    """(input, term, weight, model): the strongest relations of each input per model, itself left out.

    The limits are part of the definition; ranks are cut before the shuffle where Spark can.
    """
    keys = inputs.select("input").distinct().withColumn("known", normalise(F.col("input")))
    concepts = ontology.select(
        F.col("concept_a").alias("known"), F.col("concept_b").alias("term"), "weight",
        F.lit("SWEET").alias("model"),
    )
    relations = directed(pairs).unionByName(concepts)
    found = relations.join(keys, "known")
    w = Window.partitionBy("input", "model").orderBy(F.desc("weight"), "term")
    limit = F.when(F.col("model") == "SWEET", ONTOLOGY_LIMIT).otherwise(PAIR_LIMIT)
    ranked = found.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= ONTOLOGY_LIMIT)
    return ranked.where((F.col("_rank") <= limit) & (F.col("term") != F.col("known"))).select(
        "input", "term", "weight", "model"
    )


def model_weight(model: Column) -> Column:
    table = F.create_map(*[F.lit(p) for pair in MODEL_WEIGHTS.items() for p in pair])
    return F.coalesce(F.try_element_at(table, model), F.lit(0))


def fuse_terms(related: DataFrame, bonus: str = "hits") -> DataFrame:
    """(input, term, weight): model-weighted mean plus an agreement bonus, clamped to [0, 1].

    The bonus is 0.05 per hit beyond two (``hits``) or per unit of model weight beyond two (``weight``).
    """
    weighed = related.withColumn("_mw", model_weight(F.col("model")))
    sums = weighed.groupBy("input", "term").agg(
        F.sum(F.col("weight") * F.col("_mw")).alias("_w"), F.sum("_mw").alias("_m"),
        F.count(F.lit(1)).alias("_n"),
    )
    agreement = F.col("_n" if bonus == "hits" else "_m")
    raw = F.col("_w") / F.col("_m") + (agreement - 2) * F.lit(BONUS)
    return sums.select(
        "input", "term", round2(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))).alias("weight")
    )


def top_terms(fused: DataFrame, n: int) -> DataFrame:
    """First n fused terms of each input by falling weight, then falling name, with their rank."""
    w = Window.partitionBy("input").orderBy(F.desc("weight"), F.desc("term"))
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _joined(top: DataFrame, text: Column, separator: str) -> DataFrame:
    entry = F.struct("rank", text.alias("text"))
    return top.groupBy("input").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), separator).alias("text")
    )


def linked_terms_text(inputs: DataFrame, fused: DataFrame, n: int) -> DataFrame:
    """(input, text): ``term = weight,`` of the first n fused terms; '' without relations."""
    text = F.concat("term", F.lit(" = "), F.col("weight").cast("string"), F.lit(","))
    lines = _joined(top_terms(fused, n), text, "")
    return inputs.select("input").distinct().join(lines, "input", "left").select(
        "input", F.coalesce("text", F.lit("")).alias("text")
    )


def expand_query(inputs: DataFrame, fused: DataFrame, n: int = 3) -> DataFrame:
    """(input, query): ``(a AND b) OR (c)`` of the input and its first n fused terms."""
    more = _joined(top_terms(fused, n), conjunction(F.col("term")), " OR ")
    return inputs.select("input").distinct().join(more, "input", "left").select(
        "input", F.concat_ws(" OR ", conjunction(F.col("input")), F.col("text")).alias("query")
    )


def query_groups(inputs: DataFrame, fused: DataFrame, n: int = 3) -> DataFrame:
    """The expanded query as rows (input, part, phrase): part 0 is the input, the rest its terms."""
    own = inputs.select("input").distinct().select("input", F.lit(0).alias("part"), F.col("input").alias("phrase"))
    return own.unionByName(
        top_terms(fused, n).select("input", F.col("rank").alias("part"), F.col("term").alias("phrase"))
    )


def vocab_graph(inputs: DataFrame, related: DataFrame, n: int = 10) -> DataFrame:
    """(input, graph): JSON star of the input (group 1) and its first n terms (group 10)."""
    top = top_terms(fuse_terms(related, "weight"), n)
    entry = F.struct("rank", "term", "weight")
    gathered = top.groupBy("input").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    empty = F.array().cast("array<struct<rank:int,term:string,weight:double>>")
    stars = inputs.select("input").distinct().join(gathered, "input", "left").withColumn(
        "e", F.coalesce("e", empty)
    )
    nodes = F.concat(
        F.array(F.struct(F.col("input").alias("name"), F.lit(1).alias("group"))),
        F.transform("e", lambda x: F.struct(x["term"].alias("name"), F.lit(10).alias("group"))),
    )
    links = F.transform(
        "e",
        lambda x: F.struct(x["rank"].alias("source"), F.lit(0).alias("target"), x["weight"].alias("value")),
    )
    return stars.select("input", F.to_json(F.struct(nodes.alias("nodes"), links.alias("links"))).alias("graph"))


def report_inputs(keywords: DataFrame) -> DataFrame:
    """(section, input): the ten most frequent keywords, those counted 19 to 22 times, and the fixed ones."""
    counts = keywords.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.orderBy(F.desc("n"), "keyword").limit(10)
    middle = counts.where(F.col("n").between(19, 22))
    fixed = keywords.sparkSession.createDataFrame([(t,) for t in REPORT_TERMS], "keyword string")
    parts = [
        part.select(F.lit(name).alias("section"), F.col("keyword").alias("input"))
        for name, part in (("frequent", frequent), ("middle", middle), ("fixed", fixed))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def evaluation_report(keywords: DataFrame, pairs: DataFrame, ontology: DataFrame, n: int = 12) -> DataFrame:
    """(section, input, text): the fused terms of every reported keyword, for human judgement."""
    inputs = report_inputs(keywords)
    fused = fuse_terms(related_terms(inputs, pairs, ontology))
    return inputs.join(linked_terms_text(inputs, fused, n), "input").select("section", "input", "text")
