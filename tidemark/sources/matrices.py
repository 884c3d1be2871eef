"""Feature-matrix CSV, ontology triples, click-through JSON, labelled corpus and rule files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import round2
from tidemark.functions.text import normalise
from tidemark.operators.matrix import dense_ids
from tidemark.session import stage

# Weight of a subclass link and of any other link of the ontology.
SUBCLASS_WEIGHT = 0.75
OTHER_WEIGHT = 0.9

TASK_CELLS = 1 << 26  # of the file, zeros included, that a task writes: some 256 MB of text
MOST_TASKS = 100_000


def parse_matrix_lines(lines: DataFrame) -> DataFrame:
    """CSV rows ``term,v0,v1,…`` (column ``line``) to long form (term, feature, weight), zeros left out.

    A blank cell is a zero and keeps its place.
    """
    cells = F.split("line", ",")
    values = F.transform(
        F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda v: v.try_cast("double")
    )
    long = lines.select(F.get(cells, F.lit(0)).alias("term"), F.posexplode(values).alias("feature", "weight"))
    return long.where("weight is not null and weight <> 0")


def read_matrix(spark: SparkSession, path: str, header_rows: int = 1, key: str = "Num") -> DataFrame:
    """Matrix file to long form. Header rows start with the key name, wherever the file is split."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    if header_rows:
        lines = lines.where(~F.ltrim(F.col("line")).rlike(f"^{key},"))
    return parse_matrix_lines(lines)


def wide_matrix(long: DataFrame, features: list[str]) -> DataFrame:
    """Long form to one row per term and one column per named feature; missing cells are 0."""
    return (
        long.groupBy("term").pivot("feature", features).agg(F.sum("weight")).na.fill(0.0, subset=features)
    )


def write_matrix(long: DataFrame, features: list[str], path: str) -> None:
    """Wide CSV for tools that need it. The feature list is a column list, so it must be short."""
    wide_matrix(long, features).withColumnRenamed("term", "Num").write.mode("overwrite").csv(
        path, header=True
    )


def _one_cell(text: Column) -> Column:
    """A name as one cell of the file: commas and line ends become blanks."""
    return F.translate(text, ",\r\n", "   ")


def line_tasks(terms: int, columns: int) -> int:
    """Tasks that the lines of a matrix file are dealt in."""
    return max(1, min(MOST_TASKS, math.ceil(terms * columns / TASK_CELLS)))


def matrix_file_lines(long: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(section, term, line): a long matrix (term, feature, weight) as lines of a file with two header rows.

    Section 0 is the header of feature names, 1 the header ``f0,f1,…``, 2 one line a term; ``Num`` heads the first
    column. Columns follow the features in the order of their texts, those of ``features`` (a column ``feature``) if given,
    else those of the matrix. A term's line is put together from its own cells: between them stand as many zeros as
    the ids leave out, so nothing is pivoted and the driver holds two counts. Terms are dealt in tasks by the cells of
    their lines, zeros included: a long matrix is small beside its file. Weights of a cell named twice add up;
    cells without a term or feature are left out, a weight that is null is a zero. Without features there are no lines.
    """
    cells = stage(
        long.where("term is not null and feature is not null").groupBy(
            F.col("term").cast("string").alias("term"), F.col("feature").cast("string").alias("feature")
        ).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).cast("double").alias("weight")),
        "matrix-cells",
    )
    named = cells if features is None else features.select(F.col("feature").cast("string").alias("feature")).where("feature is not null")
    columns = stage(dense_ids(named, "feature"), "matrix-columns")
    n = columns.count()
    entry = F.struct("id", "weight")
    rows = cells.join(columns, "feature").groupBy("term").agg(F.array_sort(F.collect_list(entry)).alias("cells"))
    rows = cells.select("term").distinct().join(rows, "term", "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<struct<id:bigint,weight:double>>")))
    zeros = lambda count: F.repeat(F.lit(",0.0"), count.cast("int"))
    before = lambda i: F.coalesce(F.get("cells", i - 1)["id"], F.lit(-1))
    written = F.flatten(F.transform("cells", lambda c, i: F.array(zeros(c["id"] - before(i) - 1), F.concat(F.lit(","), c["weight"].cast("string")))))
    last = F.coalesce(F.get("cells", F.size("cells") - 1)["id"], F.lit(-1))
    body = rows.repartition(line_tasks(cells.select("term").distinct().count(), n), "term").select(
        F.lit(2).alias("section"), "term", F.concat_ws("", _one_cell(F.col("term")), written, zeros(n - 1 - last)).alias("line")
    )
    heads = columns.groupBy().agg(F.array_sort(F.collect_list(F.struct("id", "feature"))).alias("names")).where(F.size("names") > 0)
    names = F.transform("names", lambda x: _one_cell(x["feature"]))
    numbers = F.transform("names", lambda x: F.concat(F.lit("f"), x["id"].cast("string")))
    header = heads.select(F.explode(F.array(
        F.struct(F.lit(0).alias("section"), F.concat(F.lit("Num,"), F.array_join(names, ",")).alias("line")),
        F.struct(F.lit(1).alias("section"), F.concat(F.lit("Num,"), F.array_join(numbers, ",")).alias("line")),
    )).alias("h")).select("h.section", F.lit(None).cast("string").alias("term"), "h.line")
    return header.unionByName(body) if n else header


def write_matrix_file(long: DataFrame, path: str, features: DataFrame | None = None) -> None:
    """Write `matrix_file_lines` as text: the part files in the order of their names are the file."""
    matrix_file_lines(long, features).orderBy("section", "term").select("line").write.mode("overwrite").text(path)


def parse_triples(rows: DataFrame) -> DataFrame:
    """(subject, predicate, object) to (concept_a, concept_b, weight); A is the object side."""
    low = rows.select(*[F.lower(F.col(c)).alias(c) for c in ("subject", "predicate", "object")])
    return low.select(
        normalise(F.col("object")).alias("concept_a"),
        normalise(F.col("subject")).alias("concept_b"),
        F.when(F.col("predicate") == "subclassof", SUBCLASS_WEIGHT).otherwise(OTHER_WEIGHT).alias("weight"),
    )


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return parse_triples(spark.read.schema("subject string, predicate string, object string").csv(path))


CLICK_SCHEMA = (
    "query string, viewdataset string, downloaddataset string, sessionId string, type string"
)


def parse_click_lines(lines: DataFrame) -> DataFrame:
    """Click-through JSON objects (column ``line``) to one row per comma-separated query."""
    record = lines.select(F.from_json("line", CLICK_SCHEMA).alias("r")).select("r.*")
    return record.select(
        F.explode(F.split("query", ",")).alias("keyword"),
        F.col("viewdataset").alias("dataset"),
        (F.coalesce(F.col("downloaddataset"), F.lit("")) != "").alias("downloaded"),
        F.col("sessionId").alias("session_id"),
    )


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    return parse_click_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def click_json(clicks: DataFrame) -> DataFrame:
    """Click-through rows as JSON objects; the download field is empty when nothing was fetched."""
    record = F.struct(
        F.col("keyword").alias("query"),
        F.col("dataset").alias("viewdataset"),
        F.when(F.col("downloaded"), F.col("dataset")).otherwise("").alias("downloaddataset"),
        F.col("session_id").alias("sessionId"),
        F.lit("cleanup").alias("type"),
    )
    return clicks.select(F.to_json(record).alias("line"))


def corpus_line() -> Column:
    """``[id id …]<tab>tokens`` of the columns label_ids and tokens."""
    ids = F.array_join(F.transform("label_ids", lambda x: x.cast("string")), " ")
    return F.concat(F.lit("["), ids, F.lit("]\t"), F.col("tokens"))


def write_corpus(corpus: DataFrame, path: str) -> None:
    corpus.select(corpus_line().alias("value")).write.mode("overwrite").text(path)


def rule_rows(rules: DataFrame, rule_type: int) -> DataFrame:
    """Rules of one type counted at least once, the confidence at two decimals."""
    return rules.where((F.col("type") == rule_type) & (F.col("count") >= 1)).select(
        "query_a", "filter_b", "support_a", round2(F.col("confidence")).alias("confidence"), "count"
    )


def write_rules(rules: DataFrame, rule_type: int, path: str) -> None:
    rule_rows(rules, rule_type).write.mode("overwrite").csv(path, quoteAll=True)
