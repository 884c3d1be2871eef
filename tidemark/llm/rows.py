"""Row numbers that are the same at every reading of a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.joins import ids_side
from tidemark.session import stage

FILE_ROWS = 40  # log2 of the rows that a file may have


def fresh(table: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as make it unlike every column."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_row_number(table: DataFrame, name: str) -> DataFrame:
    """The table with a number for each row, made of its file and its place there.

    How Spark cuts files into tasks follows the executors alive, so numbers made of the task and the place in
    it change from job to job; these don't. `table` is read from Parquet files (columns and rows may
    have been picked); a table that isn't is written first.
    """
    path, place, number = (fresh(table, c) for c in ("_path", "_place", "_number"))
    extra = [F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place)]
    try:
        placed = table.select("*", *extra)
    except AnalysisException:
        placed = stage(table, "rows").select("*", *extra)
    files = placed.select(path).distinct()
    numbers = stage(files.withColumn(number, F.row_number().over(Window.orderBy(path)).cast("bigint")), "file-numbers")
    key = F.shiftleft(number, FILE_ROWS).bitwiseOR(F.col(place))
    return placed.join(ids_side(numbers), path).withColumn(name, key).drop(path, place, number)
