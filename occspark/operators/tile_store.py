"""Tile points kept in the order of a space-filling key, for reads by envelope (O-6.16, O-10.1).

The key interleaves the bits of a point's column and row at the deepest zoom, so every tile
of any zoom is one range of keys. Points are dealt by ranges of (year, key) into files of
about so many rows, in folders of year and coarse tile: more points give more files, however
they crowd. An envelope is covered by a few ranges; the folders they meet are listed, and
within them the ranges are pushed down to the files' minima and maxima.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..sources import versions as VS
from ..sources.scratch import remove, stored
from . import features as FE
from .tiles import ZOOMS

#: Zoom of the key, and of the folders.
KEY_ZOOM, FOLDER_ZOOM = ZOOMS[1], 9
#: Rows of a file, about.
FILE_ROWS = 2_000_000
#: Bytes of a row group.
ROW_GROUP = 8 << 20
#: Ranges that cover an envelope, at most; then the cover gets coarser.
MOST_RANGES = 64
_BY = ["year", "folder"]


def _spread(c: Column) -> Column:
    """The bits of a number up to 2**32 - 1 at every other place."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def quadkey(x: str | Column, y: str | Column, zoom: int = KEY_ZOOM) -> Column:
    """The key of the tile of ``zoom`` that a point is in: a digit to base 4 for each zoom from 1 on, 1 east and 2 south."""
    tx, ty = geo.tile_xy(x, y, F.lit(zoom))
    last = F.lit((1 << zoom) - 1).cast("long")
    inside = lambda c: F.least(F.greatest(c, F.lit(0).cast("long")), last)
    return _spread(inside(tx)).bitwiseOR(F.shiftleft(_spread(inside(ty)), 1))


def tile_range(zoom: int, tile_x: int, tile_y: int) -> tuple[int, int]:
    """First and last key of the points of a tile."""
    own = 0
    for bit in range(zoom):
        own |= (tile_x >> bit & 1) << 2 * bit | (tile_y >> bit & 1) << 2 * bit + 1
    free = 2 * (KEY_ZOOM - zoom)
    return own << free, (own + 1 << free) - 1


def cover(envelope: tuple[float, float, float, float], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of keys, ascending and apart, that hold all points of (min x, min y, max x, max y), edges included.

    Tiles are cut in four while they lie partly outside and there is room for more ranges.
    """
    x0, y0, x1, y1 = envelope
    whole, open_ = [], [(0, 0, 0)]
    while open_:
        deeper = []
        for zoom, tx, ty in open_:
            side = 2 * geo.HALF / (1 << zoom)
            # columns and rows as points are placed, so that no rounding leaves one out
            c0, c1 = (min(max(floor((x + geo.HALF) / side), 0), (1 << zoom) - 1) for x in (x0, x1))
            r0, r1 = (min(max(floor((geo.HALF - y) / side), 0), (1 << zoom) - 1) for y in (y1, y0))
            if not (c0 <= tx <= c1 and r0 <= ty <= r1):
                continue
            inside = c0 < tx < c1 and r0 < ty < r1
            (whole if inside or zoom == KEY_ZOOM else deeper).append((zoom, tx, ty))
        if len(whole) + 4 * len(deeper) > most:
            whole += deeper
            break
        open_ = [(zoom + 1, 2 * tx + dx, 2 * ty + dy) for zoom, tx, ty in deeper for dx in (0, 1) for dy in (0, 1)]
    ranges: list[tuple[int, int]] = []
    for first, last in sorted(tile_range(*t) for t in whole):
        if ranges and first <= ranges[-1][1] + 1:
            ranges[-1] = ranges[-1][0], max(last, ranges[-1][1])
        else:
            ranges.append((first, last))
    return ranges


def write_tile_points(features: DataFrame, path: str, file_rows: int = FILE_ROWS, row_group: int = ROW_GROUP) -> int:
    """O-6.16: the tile points of features (derive_search_columns) instead of what the store held; gives their number."""
    # stored, as the count, the sample for the ranges and the write would each make all features anew
    points = stored(FE.build_tile_points(features).where("x_3857 is not null and y_3857 is not null"), "points")
    key = quadkey("x_3857", "y_3857")
    keyed = points.withColumn("quadkey", key).withColumn("folder", F.shiftright("quadkey", 2 * (KEY_ZOOM - FOLDER_ZOOM)).cast("int"))
    files = max(1, -(-points.count() // file_rows))
    laid = keyed.repartitionByRange(files, "year", "quadkey", "num_bo").sortWithinPartitions("year", "quadkey")
    spark = features.sparkSession
    before = VS.listed(spark, path)
    parts = VS.write_parts(laid, path, _BY, options={"parquet.block.size": str(row_group)})
    VS.publish(spark, path, before, laid.schema, parts, {})
    remove(points)
    return sum(p.rows for p in parts)


def read_tile_points(spark: SparkSession, path: str, envelope: tuple[float, float, float, float] | None = None, years: tuple[int, ...] = ()) -> DataFrame:
    """Tile points within (min x, min y, max x, max y), edges included, of some years; without either of all."""
    table = VS.listed(spark, path)
    ranges = cover(envelope) if envelope else [(0, 1 << 62)]
    step = 2 * (KEY_ZOOM - FOLDER_ZOOM)
    meets = lambda folder: any(first >> step <= folder <= last >> step for first, last in ranges)
    parts = [p for p in table.parts.values() if (not years or p.values()["year"] in map(str, years)) and meets(int(p.values()["folder"]))]
    rows = VS.read_parts(spark, path, table, parts)
    if envelope:
        near = F.lit(False)
        for first, last in ranges:
            near = near | F.col("quadkey").between(first, last)
        x0, y0, x1, y1 = envelope
        rows = rows.where(near & F.col("x_3857").between(x0, x1) & F.col("y_3857").between(y0, y1))
    return rows.drop("folder", "quadkey")


def envelope_of(zoom: int, tile_x: int, tile_y: int, until_x: int | None = None, until_y: int | None = None) -> tuple[float, float, float, float]:
    """(min x, min y, max x, max y) of a tile, or of the tiles up to another one's column and row."""
    side = 2 * geo.HALF / (1 << zoom)
    right, bottom = (tile_x if until_x is None else until_x) + 1, (tile_y if until_y is None else until_y) + 1
    return tile_x * side - geo.HALF, geo.HALF - bottom * side, right * side - geo.HALF, geo.HALF - tile_y * side
