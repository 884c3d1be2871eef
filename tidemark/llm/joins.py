"""The side of a join that meets texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 2_000_000  # of one number each


def ids_side(ids: DataFrame) -> DataFrame:
    """A table of one number a row, to be joined with texts: sent to all tasks where it has at most `BROADCAST_ROWS`
    rows, so that texts stay where they are; a sort-merge join beyond. Results are the same."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids.hint("merge")
