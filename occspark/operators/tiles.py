"""Map tiles as tables (O-10.*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .records import KEY

# Cells along a side of a tile, by zoom.
CELLS = {10: 4, 11: 5, 12: 6, 13: 8, 14: 10, 15: 12}
ZOOMS = (10, 22)
POINTS_PER_TILE = 50_000


def matched_category(categories: tuple[str, ...] = ()) -> Column:
    """O-10.2: the feature's own category, or the least of its categories that is wanted."""
    return F.array_min(F.array_intersect("search_categories", F.array(*map(F.lit, categories)))) if categories else F.col("category")


def _bases(cells: dict[int, int]) -> dict[int, int]:
    """Zoom -> the zoom whose cells its own are made of: the finest grid that nests in it, often itself."""
    across = {z: n << z for z, n in cells.items()}
    return {z: max((b for b in cells if across[b] % across[z] == 0), key=across.__getitem__) for z in cells}


def cluster_pyramid(points: DataFrame, categories: tuple[str, ...] = (), cells: dict[int, int] = CELLS) -> DataFrame:
    """O-10.3, O-10.4: clusters of all zooms in one job.

    Cells are squares of the plane, a fixed number to a tile, so none lies in two tiles, and
    many grids nest: those of zoom 13, 12 and 10 are made of the cells of 15, that of 11 of
    the cells of 14. A point is summed in the finest grids alone; coarser ones add up cells. A
    cluster of one keeps its feature's identity, taken in the same sums.
    """
    bases = _bases(cells)
    finest = sorted(set(bases.values()))
    rows = points.select("x_3857", "y_3857", matched_category(categories).alias("category"), F.struct(*KEY, "data_ocorrencia").alias("own"), F.explode(F.array(*[F.struct(F.lit(z).alias("zoom"), F.lit(cells[z]).alias("cells")) for z in finest])).alias("at"))
    side = geo.tile_size("at.zoom") / F.col("at.cells")
    placed = rows.select(F.col("at.zoom").alias("base"), F.floor((F.col("x_3857") + geo.HALF) / side).alias("cell_x"), F.floor((F.lit(geo.HALF) - F.col("y_3857")) / side).alias("cell_y"), "category", "x_3857", "y_3857", "own")
    sums = lambda count, x, y: (F.min("category").alias("category"), count.alias("cluster_count"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.min("own").alias("own"))
    made = placed.groupBy("base", "cell_x", "cell_y").agg(*sums(F.count(F.lit(1)), "x_3857", "y_3857"))
    steps = [F.struct(F.lit(base).alias("base"), F.lit(z).alias("zoom"), F.lit(cells[z]).alias("cells"), F.lit((cells[base] << base) // (cells[z] << z)).alias("by")) for z, base in bases.items()]
    each = made.select("*", F.explode(F.filter(F.array(*steps), lambda s: s["base"] == F.col("base"))).alias("to"))
    coarse = each.select(F.col("to.zoom").alias("zoom"), F.col("to.cells").alias("cells"), F.floor(F.col("cell_x") / F.col("to.by")).alias("cell_x"), F.floor(F.col("cell_y") / F.col("to.by")).alias("cell_y"), "category", "cluster_count", "x", "y", "own")
    whole = coarse.groupBy("zoom", "cells", "cell_x", "cell_y").agg(*sums(F.sum("cluster_count"), "x", "y"))
    single = F.col("cluster_count") == 1
    mean = lambda c: (F.col(c) / F.col("cluster_count")).alias(c)
    return whole.select("zoom", F.floor(F.col("cell_x") / F.col("cells")).cast("long").alias("tile_x"), F.floor(F.col("cell_y") / F.col("cells")).cast("long").alias("tile_y"), "cell_x", "cell_y", "category", "cluster_count", mean("x"), mean("y"), single.alias("is_singleton"), (~single).alias("is_cluster"), *[F.when(single, F.col(f"own.{k}")).alias(k) for k in ("num_bo", "ano_bo", "delegacia", "data_ocorrencia")])


def cluster_points(points: DataFrame, zoom: int, categories: tuple[str, ...] = ()) -> DataFrame:
    """O-10.3: the clusters of one zoom from 10 to 15."""
    return cluster_pyramid(points, categories, {zoom: CELLS[zoom]})


#: The setting up to which Spark keeps each task's first rows of a group before they are shuffled.
_GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def raw_points(points: DataFrame, zoom: int, categories: tuple[str, ...] = (), most: int = POINTS_PER_TILE) -> DataFrame:
    """O-10.5: points with their tile and their place in it, from zoom 16 on; at most ``most`` to a tile, by key.

    A task sends the first ``most`` points of each tile at most: the session's limit for that
    is raised to ``most`` if it is lower, so a very full tile moves ``most`` rows a task.
    """
    if not 16 <= zoom <= ZOOMS[1]:
        raise ValueError(f"points start at zoom 16: {zoom}")
    spark = points.sparkSession
    if int(spark.conf.get(_GROUP_LIMIT)) < most:
        spark.conf.set(_GROUP_LIMIT, most)
    tx, ty = geo.tile_xy("x_3857", "y_3857", F.lit(zoom))
    px, py = geo.tile_pixel("x_3857", "y_3857", F.lit(zoom))
    rows = points.select(*KEY, matched_category(categories).alias("category"), "total_records", tx.alias("tile_x"), ty.alias("tile_y"), px.alias("pixel_x"), py.alias("pixel_y"))
    order = Window.partitionBy("tile_x", "tile_y").orderBy(*KEY)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n").withColumn("zoom", F.lit(zoom))
