"""Dataset metadata: JSON lines, delimited lines and DIF XML in; JSON lines and split tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import split_comma_list

JSON_SCHEMA = (
    "shortName string, longName string, keywordStr string, termStr string, topicStr string, "
    "variableStr string, abstractStr string"
)
DIF_SCHEMA = (
    "Entry_ID string, Entry_Title string, Summary struct<Abstract:string>, "
    "ISO_Topic_Category array<string>, "
    "Sensor_Name struct<Short_Name:string,Long_Name:string>, "
    "Source_Name struct<Short_Name:string,Long_Name:string>, "
    "Project struct<Short_Name:string,Long_Name:string>"
)
DELIMITED_FIELDS = ("short_name", "long_name", "topic", "term", "variable", "keyword")


def _from_json_fields(table: DataFrame) -> DataFrame:
    return table.select(
        F.col("shortName").alias("short_name"),
        F.col("longName").alias("long_name"),
        F.col("keywordStr").alias("keyword"),
        F.col("termStr").alias("term"),
        F.col("topicStr").alias("topic"),
        F.col("variableStr").alias("variable"),
        F.try_url_decode("abstractStr").alias("abstract"),
    )


def parse_json_lines(lines: DataFrame) -> DataFrame:
    """Metadata records from a column ``line`` of JSON objects (a trailing comma is tolerated)."""
    record = F.from_json(F.regexp_replace("line", r",\s*$", ""), JSON_SCHEMA)
    return _from_json_fields(lines.select(record.alias("r")).select("r.*"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_json_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def parse_delimited_lines(lines: DataFrame) -> DataFrame:
    """``short, long, topic, term, variable, keyword list``: five splits at ", ", the rest is the list."""
    parts = F.split("line", ", ", 6)
    columns = [F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(DELIMITED_FIELDS)]
    return lines.where(F.size(parts) == 6).select(*columns)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    return parse_delimited_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def _name_pair(name: str) -> Column:
    return F.concat_ws(
        ",", F.trim(F.col(f"{name}.Short_Name")), F.trim(F.col(f"{name}.Long_Name"))
    )


def _from_dif_fields(table: DataFrame) -> DataFrame:
    return table.select(
        F.col("Entry_ID").alias("short_name"),
        F.col("Entry_Title").alias("long_name"),
        F.trim(F.col("Summary.Abstract")).alias("abstract"),
        F.array_join("ISO_Topic_Category", ",").alias("isotopic"),
        _name_pair("Sensor_Name").alias("sensor"),
        _name_pair("Source_Name").alias("source"),
        _name_pair("Project").alias("project"),
    )


def parse_dif(records: DataFrame) -> DataFrame:
    """DIF documents in a string column ``xml``, one document per row."""
    parsed = records.select(F.from_xml("xml", DIF_SCHEMA).alias("d")).select("d.*")
    return _from_dif_fields(parsed)


def read_dif(spark: SparkSession, path: str) -> DataFrame:
    return _from_dif_fields(spark.read.format("xml").option("rowTag", "DIF").schema(DIF_SCHEMA).load(path))


TERM_FIELDS = ("term", "keyword", "topic", "variable", "isotopic", "sensor", "source", "project")


def all_terms(table: DataFrame) -> Column:
    """Every term list of a dataset, concatenated; duplicates are kept because they are the tf."""
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(split_comma_list(F.col(c)), empty) for c in TERM_FIELDS if c in table.columns]
    return F.concat(*lists)


def subject_terms(table: DataFrame) -> Column:
    """Distinct members of the term, topic, variable and keyword lists."""
    empty = F.array().cast("array<string>")
    fields = ("term", "topic", "variable", "keyword")
    lists = [F.coalesce(split_comma_list(F.col(c)), empty) for c in fields if c in table.columns]
    return F.array_distinct(F.concat(*lists))


def to_json_record() -> Column:
    """JSON object of one metadata row: quotes cut from the long name, the abstract URL-encoded."""
    return F.to_json(
        F.struct(
            F.col("short_name").alias("shortName"),
            F.replace(F.col("long_name"), F.lit('"'), F.lit("")).alias("longName"),
            F.col("keyword").alias("keywordStr"),
            F.col("term").alias("termStr"),
            F.col("topic").alias("topicStr"),
            F.col("variable").alias("variableStr"),
            F.url_encode("abstract").alias("abstractStr"),
        )
    )


def write_json(table: DataFrame, path: str) -> None:
    table.select(to_json_record().alias("value")).write.mode("overwrite").text(path)


def split_by_abstract(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an abstract and rows without one."""
    return table.where("abstract is not null"), table.where("abstract is null")


def write_split(table: DataFrame, with_path: str, without_path: str) -> None:
    described, bare = split_by_abstract(table)
    described.write.mode("overwrite").parquet(with_path)
    bare.write.mode("overwrite").parquet(without_path)
