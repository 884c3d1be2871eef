"""Monthly tables and replaceable result tables on a partitioned path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_months(
    spark: SparkSession, path: str, months: Sequence[str] | None = None, schema: StructType | None = None
) -> DataFrame:
    """One table over all months, or the named ones only (partition pruning, no loop over months).

    With a schema a table without any row can be read too.
    """
    table = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    return table if months is None else table.where(F.col("month").isin(*months))


def read_years(spark: SparkSession, path: str, years: Sequence[int]) -> DataFrame:
    table = spark.read.parquet(path)
    return table.where(F.substring("month", 1, 4).isin(*[str(y) for y in years]))


def read_prefixed(spark: SparkSession, prefix: str) -> DataFrame:
    """All catalog tables whose name starts with a prefix, as one; missing columns become null."""
    names = sorted(t.name for t in spark.catalog.listTables(pattern=f"{prefix}*"))
    if not names:
        raise ValueError(f"no table starts with {prefix!r}")
    table = spark.table(names[0])
    for name in names[1:]:
        table = table.unionByName(spark.table(name), allowMissingColumns=True)
    return table


def write_months(table: DataFrame, path: str) -> None:
    """Replace only the months present in ``table``; other months on the path stay."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "month"
    ).parquet(path)


def _drop_partitions(spark: SparkSession, path: str, column: str, values: Sequence[str]) -> None:
    for value in values:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def replace_months(table: DataFrame, path: str, months: Sequence[str] | None = None) -> None:
    """Replace the named months, all if None, also those for which ``table`` has no rows any more.

    A run that fails between the two steps is repaired by running it again.
    """
    if months is None:
        table.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("month").parquet(path)
        return
    _drop_partitions(table.sparkSession, path, "month", months)
    table.where(F.col("month").isin(*months)).write.mode("append").partitionBy("month").parquet(path)


def write_term_pairs(pairs: DataFrame, path: str, models: Sequence[str] | None = None) -> None:
    """Replace the stored pairs of the named models, empty or not; without names, of those in ``pairs``."""
    rows = pairs.select("term_a", "term_b", "weight", "model")
    if models is None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)
        return
    _drop_partitions(pairs.sparkSession, path, "model", models)
    rows.where(F.col("model").isin(*models)).write.mode("append").partitionBy("model").parquet(path)


def delete_where(spark: SparkSession, path: str, target: str, condition) -> None:
    """Write the rows that do not match a condition to ``target`` (files are never edited in place)."""
    keep = spark.read.parquet(path).where(~F.coalesce(condition, F.lit(False)))
    keep.write.mode("overwrite").parquet(target)
