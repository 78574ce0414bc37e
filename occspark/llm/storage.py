"""Shared scratch storage: tables that cut lineage and survive lost executors."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_path, remove, shared_dir, stored

__all__ = ["new_path", "remove", "shared_dir", "small", "stored"]

#: Rows, of up to four numbers or 128-bit prints each, that a counted table may have to be broadcast.
SMALL_ROWS = 100_000


def small(table: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it is counted to have at most SMALL_ROWS rows; a larger one is joined by a shuffle."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table
