"""Cells of grids as a table function: `grid_cells(TABLE(grids) PARTITION BY key)`, from SQL or DataFrames.

The function takes grids (key first, then ring, epsg, left, top, width, height, resolution) and gives
(key, row, col, x, y, in_aoi). Grids are dealt to tasks by key. Cells are made in bands, of many small grids or of some
rows of a large one, so a task holds a band of cells, however large the grid. A cell is in when its centre is, by the
parity of the sides right of it. The function for SQL takes keys of any type, a row at a time; `cells` knows the type
beforehand and calls an Arrow function, which takes and gives batches.

Defined cases: a grid without a row or column, or with a NULL, has no cells; without a ring no cell is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, arrow_udtf, udtf
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from verdara.functions import projection
from verdara.session import ship

#: Cells of a band.
BAND = 65_536
#: Lots of grids that `cells` deals to tasks.
LOTS = 1_000


NAMES = ("row", "col", "x", "y", "in_aoi")


def _made(key: StructField) -> StructType:
    made = StructType().add(key.name, key.dataType)
    for name, kind in zip(NAMES, (IntegerType(), IntegerType(), DoubleType(), DoubleType(), BooleanType()), strict=True):
        made = made.add(name, kind)
    return made


class GridCells:
    @staticmethod
    def analyze(grids: AnalyzeArgument) -> AnalyzeResult:
        if not grids.isTable or len(grids.dataType.fields) != 8:
            raise ValueError("grid_cells takes a table of key, ring, epsg, left, top, width, height, resolution")
        return AnalyzeResult(schema=_made(grids.dataType.fields[0]))

    def eval(self, grid: Row) -> Iterator[tuple]:
        key, ring, _, *numbers = grid
        if None in numbers:
            return
        corners = np.array([(c["x"], c["y"]) for c in ring or []], float).reshape(-1, 2)
        for _, *made in _cells(*(np.array([v], float) for v in numbers), corners, np.array([len(corners)])):
            for cell in zip(*(v.tolist() for v in made), strict=True):
                yield key, *cell


class GridCellBatches:
    """The same for many grids at once: an Arrow function, whose columns are to be named beforehand."""

    def eval(self, grids: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ring = grids.column(1)
        corners = ring.flatten()
        points = np.column_stack([_numbers(pc.struct_field(corners, k)) for k in "xy"])
        sides = pc.fill_null(pc.list_value_length(ring), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for grid, *made in _cells(*(_numbers(grids.column(k)) for k in range(3, 8)), points, sides):
            yield pa.RecordBatch.from_arrays([grids.column(0).take(pa.array(grid)), *map(pa.array, made)], names=[grids.schema.names[0], *NAMES])


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(float)


def _cells(left, top, width, height, res, p, sides) -> Iterator[tuple[np.ndarray, ...]]:
    """(grid, row, col, x, y, in_aoi) in bands: of each grid its numbers (NaN: missing), and in turn its ring's corners, so many of `p`."""
    whole = np.flatnonzero((width >= 1) & (height >= 1) & ~np.isnan(left + top + res))
    width, height = (np.where(np.isnan(v), 0, v).astype(np.int64) for v in (width, height))
    start = np.cumsum(sides) - sides
    after = np.arange(len(p)) + 1
    after[(start + sides - 1)[sides > 0]] = start[sides > 0]
    q = p[after]

    # A grid's rows of cells in pieces, and pieces of many small grids together, of about BAND cells or sides.
    weight = np.maximum(width, sides)
    high = np.maximum(1, BAND // np.maximum(1, weight))[whole]
    pieces = -(-height[whole] // high)
    of, most = np.repeat(whole, pieces), np.repeat(high, pieces)
    first = _within(pieces) * most
    rows = np.minimum(most, height[of] - first)
    band = np.cumsum(rows * weight[of]) // BAND
    for own in np.split(np.arange(len(of)), np.flatnonzero(np.diff(band)) + 1):
        if len(own) == 0:
            continue
        g = np.repeat(of[own], rows[own])
        row = _within(rows[own]) + np.repeat(first[own], rows[own])
        y = top[g] - (row + 0.5) * res[g]

        # Crossings of the rows' centre lines, and how many centres of the row lie left of each.
        r = np.repeat(np.arange(len(g)), sides[g])
        side = _within(sides[g]) + start[g][r]
        cut = (p[side, 1] > y[r]) != (q[side, 1] > y[r])
        r, a, b = r[cut], p[side[cut]], q[side[cut]]
        at = (b[:, 0] - a[:, 0]) * (y[r] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
        low, step, wide = left[g[r]], res[g[r]], width[g[r]]
        n = np.where(np.isnan(at), wide, np.clip(np.ceil((at - low) / step - 0.5), 0, wide))
        n -= (n > 0) & (low + (n - 0.5) * step >= at)
        n += (n < wide) & (low + (n + 0.5) * step < at)
        n = n.astype(np.int64)

        # A cell is in if an odd number of its row's crossings lie right of it.
        w = width[g]
        begin = np.cumsum(w) - w
        seen = np.cumsum(np.bincount((begin[r] + n - 1)[n > 0], minlength=int(w.sum())))
        cell, col = np.repeat(np.arange(len(g)), w), _within(w)
        right = seen[begin + w - 1][cell] - np.concatenate(([0], seen[:-1]))
        grid = g[cell]
        yield grid, row[cell].astype(np.int32), col.astype(np.int32), left[grid] + (col + 0.5) * res[grid], y[cell], right % 2 == 1


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the groups of these sizes."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def register(spark: SparkSession) -> None:
    """Makes `grid_cells` known to SQL of this session."""
    ship(spark)
    spark.udtf.register("grid_cells", udtf(GridCells))


def cells(grids: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """(key, row, col, x, y, in_aoi) of `canonical_grids` with a key, through the table function for batches."""
    register(grids.sparkSession)
    flat = grids.select(key, projection.ring_utm(F.col(ring), F.col("epsg")).alias("ring"), "epsg", "left", "top", "width", "height", "resolution")
    function = arrow_udtf(GridCellBatches, returnType=_made(flat.schema[0]))
    return function(flat.asTable().partitionBy(F.pmod(F.hash(F.col(key)), F.lit(LOTS))))
