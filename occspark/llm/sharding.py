"""Shards cut as runs of a Hilbert curve over quantised metadata. DataFrame functions only.

Documents that are close in every dimension end in the same shard, so a reader that filters
on any of them opens few files: :func:`shard_ranges` gives the bounds to prune by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranking import ranked
from .storage import stored

#: Accuracy of the quantile cuts: errors of at most one in so many rows.
ACCURACY = 2_000
#: Distinct values of a column that may be broadcast with their cells.
BROADCAST_VALUES = 100_000


def hilbert_steps(n: int) -> list[int]:
    """The n-dimensional curve as a table: [(entry * n + axis) * 2**n + corner] -> packed step.

    A cell's sub-cube is walked in Gray-code order, turned by the entry corner and axis of the
    cell; a step packs (place on the curve, next entry, next axis).
    """
    size, mask = 1 << n, (1 << n) - 1

    def turn(x: int, by: int) -> int:
        by %= n
        return ((x << by) | (x >> (n - by))) & mask

    gray = [i ^ (i >> 1) for i in range(size)]
    place = {g: i for i, g in enumerate(gray)}

    def ones(x: int) -> int:
        return (~x & (x + 1)).bit_length() - 1

    table = []
    for entry in range(size):
        for axis in range(n):
            for corner in range(size):
                w = place[turn(corner ^ entry, -(axis + 1))]
                first = 0 if w == 0 else gray[2 * ((w - 1) // 2)]
                along = 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n
                table.append((w * size + (entry ^ turn(first, axis + 1))) * n + (axis + along + 1) % n)
    return table


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point whose coordinates are ``bits``-bit integers."""
    n = len(cells)
    size = 1 << n
    steps = F.array(*[F.lit(s) for s in hilbert_steps(n)])

    def step(state: Column, bit: Column) -> Column:
        corner = F.lit(0)
        for k, cell in enumerate(cells):
            corner = corner + F.get(F.array(*[cell.bitwiseAND(F.lit(1 << b)).cast("boolean").cast("int") for b in range(bits)]), bit) * F.lit(1 << k)
        got = F.get(steps, state["turn"] * size + corner)
        n_size = n * size
        return F.struct((state["at"] * size + F.floor(got / n_size)).cast("long").alias("at"), F.pmod(got, F.lit(n_size)).cast("int").alias("turn"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("turn"))
    return F.aggregate(F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)]), start, step, lambda s: s["at"])


def value_cells(rows: DataFrame, column: str, cells: int) -> DataFrame:
    """(value, cell) of each distinct value of a text column: where the middle of its rows lies among all, in ``cells`` equal parts; null first.

    Distinct values are dealt by ranges of their order and summed in each; what lies before a
    range is a sum over ranges, so no task sees all values.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    dealt = stored(counted.repartitionByRange(n, "value").withColumn("part", F.spark_partition_id()), "values")
    parts = dealt.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each range
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = parts.select(F.col("part").alias("_part"), (F.sum("n").over(along) - F.col("n")).alias("_start"), F.sum("n").over(Window.partitionBy()).alias("_all"))
    own = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    middle = F.col("_start") + F.col("own") - F.col("n") / 2
    placed = dealt.withColumn("own", own).join(F.broadcast(starts), F.col("part") == F.col("_part"))
    return placed.select("value", F.least(F.lit(cells - 1), F.floor(middle * cells / F.col("_all"))).cast("int").alias("cell"))


def hilbert_shards(docs: DataFrame, n_shards: int = 40, bits: int = 3) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    Dimensions: lang, source (whole values in their order), size (UTF-8 bytes plus 16) and
    doc_id, each cut at quantiles into 2**bits cells, so that a hot source or many copies
    spread along the others. Rows are
    ranked along the curve and cut into ``n_shards`` runs by the law ``rows``: counts differ
    by one at most. slot counts from 0 within a shard. Nulls: an empty text (crc32 0), or the
    first cell of the dimension. An empty table gives no rows; repeated rows each get a slot.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    crc = F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long")
    texts, numbers = ["lang", "source"], {"_size": size.cast("double"), "_id": F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0))}
    thin = docs.select("doc_id", *[F.col(c).cast("string").alias(c) for c in texts], F.col("text").cast("string").alias("text"))
    thin = stored(thin.select(F.col("doc_id").cast("long").alias("doc_id"), *texts, size.alias("size"), crc.alias("text_crc32"), *[c.alias(k) for k, c in numbers.items()]), "metadata")
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = thin.agg(F.count(F.lit(1)).alias("_rows"), *[F.percentile_approx(k, shares, ACCURACY).alias(f"{k}_cuts") for k in numbers])
    placed = thin.join(F.broadcast(cuts))  # one row
    for c in texts:
        cells = stored(value_cells(thin, c, 1 << bits), "cells").select(F.col("value").alias(f"_{c}_value"), F.col("cell").alias(f"_{c}"))
        few = F.broadcast(cells) if cells.count() <= BROADCAST_VALUES else cells
        placed = placed.join(few, F.col(c).eqNullSafe(F.col(f"_{c}_value")))
    dims = [f"_{c}" for c in texts] + list(numbers)
    coded = placed.select("doc_id", "size", "text_crc32", "_rows", *[f"_{c}" for c in texts], *[F.expr(f"size(filter({k}_cuts, c -> c < {k}))").alias(k) for k in numbers])
    curve = coded.withColumn("_cell", hilbert_index([F.col(k) for k in dims], bits)).drop(*dims)
    run = ranked(curve, "_cell", ["doc_id", "text_crc32", "size"], across=True)
    shard = F.expr(f"(rank * {n_shards}L) div _rows")
    start = F.expr(f"(shard * _rows + {n_shards - 1}L) div {n_shards}L")
    return run.withColumn("shard", shard).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), (F.col("rank") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_ranges(sharded: DataFrame, docs: DataFrame) -> DataFrame:
    """(shard, rows, bytes and the least and greatest lang, source, size and doc_id): what a reader prunes by."""
    told = sharded.select(F.col("doc_id").alias("_id"), "shard", "size").join(docs.select("doc_id", "lang", "source"), F.col("_id").eqNullSafe(F.col("doc_id")))
    bounds = [f(c).alias(f"{n}_{c}") for c in ("lang", "source", "size", "doc_id") for n, f in (("min", F.min), ("max", F.max))]
    return told.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *bounds)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 runs of the curve."""
    return hilbert_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
