"""Pixels at rest: a table of tiles, laid out along a Z-curve, of which a window reads the row groups that it meets.

A tile is (item_id, band, tile_row, tile_col) with the values of its cells: all of them in order where the tile is full, else
those that are known and their places (`at`). Missing pixels are absent, a known NULL or NaN isn't stored either.
Rows lie by z, the interleaved bits of tile_row and tile_col, so a row group holds a square of neighbouring tiles and its
least and largest tile_row and tile_col are close; a window's comparisons reach the scan. Tiles are decoded by built-ins.

Defined cases: several values of one cell of a band are one of them, the largest; rows or columns below 0 aren't stored; a
window beyond the raster, or of an item that isn't there, gives no rows; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 64
KEY = ("item_id", "band", "tile_row", "tile_col")


def _spread(x: Column) -> Column:
    """The low 16 bits with a zero between each two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = F.shiftleft(x, shift).bitwiseOR(x).bitwiseAND(F.lit(mask).cast("long"))
    return x


def z_order(row: Column, col: Column) -> Column:
    """Place of a tile on the Z-curve."""
    return F.shiftleft(_spread(row.cast("long")), 1).bitwiseOR(_spread(col.cast("long")))


def tiles_of(pixels: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles of pixels (item_id, band, row, col, value), by one aggregate; a tile's state has its own cells only."""
    value = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    where = [F.floor(F.col(c) / size).cast("int").alias(f"tile_{c}") for c in ("row", "col")]
    at = (F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))).cast("int")
    cells = pixels.where((F.col("row") >= 0) & (F.col("col") >= 0)).select("item_id", "band", *where, at.alias("at"), value.alias("value")).where("value is not null")
    one = cells.groupBy(*KEY, "at").agg(F.max("value").alias("value"))
    made = one.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("cells"))
    full = F.size("cells") == size * size
    z = z_order(F.col("tile_row"), F.col("tile_col"))
    return made.select(*KEY, z.alias("z"), F.when(~full, F.col("cells.at")).alias("at"), F.col("cells.value").alias("values"))


def write(pixels: DataFrame, path: str, size: int = SIZE, tiles_per_group: int = 256, partitions: int | None = None) -> None:
    """Store pixels as tiles. Files are ranges of the curve; inside a file tiles stand by z, so that groups are squares."""
    made = tiles_of(pixels, size)
    ranged = made.repartitionByRange(partitions, "z") if partitions else made.repartitionByRange("z")
    ordered = ranged.sortWithinPartitions("z", "item_id", "band")
    ordered.write.option("parquet.block.row.count.limit", tiles_per_group).option("parquet.page.row.count.limit", tiles_per_group).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def window(tiles: DataFrame, rows: tuple[int, int], cols: tuple[int, int], size: int = SIZE) -> DataFrame:
    """(item_id, band, row, col, value) of the pixels of rows and columns from the first to before the second."""
    (top, bottom), (left, right) = rows, cols
    first, last = (top // size, left // size), ((bottom - 1) // size, (right - 1) // size)
    c = F.col
    near = c("tile_row").between(first[0], last[0]) & c("tile_col").between(first[1], last[1])
    # Along the curve the corners' places are the least and the largest of a window.
    on_curve = c("z").between(_z(*first), _z(*last))
    at = F.coalesce(c("at"), F.sequence(F.lit(0), F.lit(size * size - 1)))
    cells = tiles.where(near & on_curve).select(*KEY, F.explode(F.arrays_zip(at.alias("at"), c("values").alias("value"))).alias("p"))
    row = c("tile_row") * size + F.floor(c("p.at") / size).cast("int")
    out = cells.select("item_id", "band", row.alias("row"), (c("tile_col") * size + c("p.at") % size).alias("col"), c("p.value").alias("value"))
    return out.where((c("row") >= top) & (c("row") < bottom) & (c("col") >= left) & (c("col") < right))


def _z(row: int, col: int) -> int:
    return sum((row >> k & 1) << 2 * k + 1 | (col >> k & 1) << 2 * k for k in range(16))
