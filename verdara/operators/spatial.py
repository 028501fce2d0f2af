"""Spatial join of boxes: hierarchical cells, one equality join, each pair once.

A box's level is the finest whose cells (360 / 2**level degrees) are no smaller than the box, so it lies in four cells
of it at most. It stands in these, and in the cells of each coarser level that the other side has boxes of. Two boxes
are compared at the coarser of their levels, in the one cell that holds the lower left corner of what they share.

Cells with very many boxes of the left side are split: their boxes are dealt into parts and the right side's boxes copied
to each. Boxes are closed, so those that touch meet. Rows with a NULL, or with west beyond east or south beyond
north, meet nothing; what lies beyond 180 or 90 degrees falls to the cells at the rim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdara.session import scratch_path

DEEPEST = 20
#: Boxes of one cell that one task compares with the other side's.
LIMIT = 50_000
BOX = ("west", "south", "east", "north")


def _level(box: dict[str, Column]) -> Column:
    span = F.greatest(box["east"] - box["west"], box["north"] - box["south"], F.lit(360 / 2**DEEPEST))
    return F.greatest(F.lit(0), F.floor(F.log2(F.lit(360.0) / span))).cast("int")


def _place(x: Column, level: Column) -> Column:
    """Number of the column or row of cells at a level in which a coordinate lies."""
    cells = F.pow(F.lit(2.0), level)
    return F.least(F.greatest(F.floor((x + 180) / 360 * cells), F.lit(0)), F.floor(cells) - 1).cast("long")


def _cell(level: Column, column: Column, row: Column) -> Column:
    return F.shiftleft(level.cast("long"), 48) + F.shiftleft(column, 24) + row


def _in_cells(boxes: DataFrame, levels: list[int], mark: str) -> DataFrame:
    """The rows once for each cell, with `{mark}_own`: whether the cell is of the box's own level."""
    box = {n: F.col(f"{mark}_{n}") for n in BOX}
    own = _level(box)
    level = F.explode(F.array_distinct(F.concat(F.array(own), F.filter(F.array(*[F.lit(k) for k in levels]).cast("array<int>"), lambda k: k < own))))
    rows = boxes.withColumn(f"{mark}_level", own).withColumn("_level", level)
    span = lambda low, high: F.explode(F.sequence(_place(box[low], F.col("_level")), _place(box[high], F.col("_level"))))
    rows = rows.withColumn("_column", span("west", "east")).withColumn("_row", span("south", "north"))
    cell = _cell(F.col("_level"), F.col("_column"), F.col("_row"))
    return rows.select(*boxes.columns, (F.col("_level") == F.col(f"{mark}_level")).alias(f"{mark}_own"), "_level", cell.alias("_cell"))


def _marked(frame: DataFrame, box: dict[str, Column], mark: str) -> DataFrame:
    """The row's columns, numbered, beside its box; rows without a box are left out."""
    rows = frame.select(*[F.col(f"`{c}`").alias(f"{mark}{k}") for k, c in enumerate(frame.columns)], *[box[n].cast("double").alias(f"{mark}_{n}") for n in BOX])
    # Stored, as each step below looks at them anew, and each filter, pushed down, would work the boxes out again.
    path = scratch_path(frame.sparkSession, "boxes")
    rows.write.parquet(path)
    rows = frame.sparkSession.read.schema(rows.schema).parquet(path)
    return rows.where((F.col(f"{mark}_west") <= F.col(f"{mark}_east")) & (F.col(f"{mark}_south") <= F.col(f"{mark}_north")))


def _whole(frame: DataFrame, mark: str) -> Column:
    """The struct of a row's columns, made last, so that those nobody asks for aren't carried."""
    return F.struct(*[F.col(f"{mark}{k}").alias(c) for k, c in enumerate(frame.columns)]).alias(mark)


def _levels(rows: DataFrame, mark: str) -> list[int]:
    """Levels in use: 21 at most."""
    return sorted(r[0] for r in rows.select(_level({n: F.col(f"{mark}_{n}") for n in BOX})).distinct().collect())


def meeting(left: DataFrame, right: DataFrame, left_box: dict[str, Column], right_box: dict[str, Column], limit: int = LIMIT) -> DataFrame:
    """(l, r): structs of the rows of both sides whose boxes (west, south, east, north) have a point in common."""
    a, b = _marked(left, left_box, "l"), _marked(right, right_box, "r")
    a_levels, b_levels = _levels(a, "l"), _levels(b, "r")
    x = _in_cells(a, b_levels, "l")
    y = _in_cells(b, a_levels, "r").drop("_level")
    parts = x.groupBy("_cell").count().where(F.col("count") > limit).select("_cell", F.ceil(F.col("count") / limit).alias("_parts"))
    x = x.withColumn("_nth", F.monotonically_increasing_id()).join(parts, "_cell", "left").withColumn("_part", F.coalesce(F.pmod("_nth", "_parts"), F.lit(0)).cast("long"))
    y = y.join(parts, "_cell", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
    c = F.col
    west, south = F.greatest("l_west", "r_west"), F.greatest("l_south", "r_south")
    shared = (west <= F.least("l_east", "r_east")) & (south <= F.least("l_north", "r_north"))
    here = c("_cell") == _cell(c("_level"), _place(west, c("_level")), _place(south, c("_level")))
    return x.join(y, ["_cell", "_part"]).where((c("l_own") | c("r_own")) & shared & here).select(_whole(left, "l"), _whole(right, "r"))
