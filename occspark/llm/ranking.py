"""Ranks within groups of any size, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task sorts at most, about. Larger groups are split by a hash.
ROWS_PER_SORT = 50_000


def ranked(df: DataFrame, group: str, order: list[str], across: bool = False, rows_per_sort: int = ROWS_PER_SORT) -> DataFrame:
    """``df`` with a gapless ``rank`` from 0 within each value of ``group``, or across them.

    ``group`` takes a bounded number of non-null values (its counts are broadcast). A group is
    cut by a hash of ``order`` into parts of about ``rows_per_sort`` rows; parts follow each
    other, and ``order`` decides within a part, so no task sorts a whole hot group. With
    ``across`` groups follow each other in their own order and one rank runs through all of
    them. Rows that are equal in all of ``order`` share a part and get ranks in any order.
    """
    parts = df.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows_per_sort)).cast("int").alias("_parts"))
    split = df.join(F.broadcast(parts), group).withColumn("_part", F.pmod(F.xxhash64(*order), F.col("_parts")).cast("int")).drop("_parts")
    # one row for each part: a few for each group and rows_per_sort rows
    sizes = split.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(group, "_part") if across else Window.partitionBy(group).orderBy("_part")
    starts = sizes.select(F.col(group).alias("_group"), F.col("_part").alias("_own"), (F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    placed = split.withColumn("_row", within - 1)
    joined = placed.join(starts, (placed[group] == starts["_group"]) & (placed["_part"] == starts["_own"]))
    return joined.withColumn("rank", (F.col("_start") + F.col("_row")).cast("long")).drop("_part", "_group", "_own", "_start", "_row")
