"""How many rows a Python worker is handed at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = 1000


def bounded_batches(table: DataFrame) -> DataFrame:
    """The table, in a session whose Arrow batches hold `ROWS` rows: texts are long, and workers share an executor's memory."""
    table.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    return table
