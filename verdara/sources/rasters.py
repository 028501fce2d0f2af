"""GeoTIFF files as tables: headers, and the cells of a window.

Spark lists and reads the files; a task decodes the blocks of its file that the window meets, no others. Little-endian
and big-endian files of one band are read, in tiles or strips, plain or deflated, with or without horizontal
differencing of whole numbers. Missing cells have no value.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from verdara.session import ship

# The format's field types (size, code), and its sample formats.
FIELDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
KINDS = {1: "u", 2: "i", 3: "f"}
HEADER = "path string, width int, height int, dtype string, epsg int, left double, top double, resolution array<double>, nodata double, block array<int>, overviews int, problem string"


@dataclass
class Raster:
    """A file's first directory; `overviews` are the widths of those that follow."""

    data: bytes
    order: str
    tags: dict[int, tuple]
    overviews: list[int]

    @classmethod
    def open(cls, data: bytes) -> Raster:
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
            raise ValueError("not a TIFF file")
        (at,), found = struct.unpack(order + "I", data[4:8]), []
        while at and len(found) < 32:
            tags, at = cls._directory(data, order, at)
            found.append(tags)
        return cls(data, order, found[0], [t[256][0] for t in found[1:]])

    @staticmethod
    def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in FIELDS:
                size, code = FIELDS[kind]
                place = at + 10 + 12 * k
                start = place if size * count <= 4 else struct.unpack_from(order + "I", data, place)[0]
                tags[tag] = (data[start : start + count],) if kind == 2 else struct.unpack_from(f"{order}{count}{code}", data, start)
        return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"{self.order}{KINDS[self.one(339, 1)]}{self.one(258, 1) // 8}")

    @property
    def nodata(self) -> float | None:
        text = self.one(42113)
        return float(text.rstrip(b"\0 ")) if text else None

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get(34735, ())
        named = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        return named.get(3072, named.get(2048))

    @property
    def block(self) -> tuple[int, int]:
        """Width and height of a block."""
        return (self.one(322), self.one(323)) if 322 in self.tags else (self.one(256), self.one(278, self.one(257)))

    def window(self, row: int, col: int, height: int, width: int) -> tuple[int, int, np.ndarray]:
        """(row, col, values) of the part of the window that lies in the raster."""
        w, h = self.one(256), self.one(257)
        r0, r1, c0, c1 = max(row, 0), min(row + height, h), max(col, 0), min(col + width, w)
        if r0 >= r1 or c0 >= c1:
            return r0, c0, np.empty((0, 0), self.dtype)
        bw, bh = self.block
        across, tiled = -(-w // bw), 322 in self.tags
        starts, sizes = (self.tags[324], self.tags[325]) if tiled else (self.tags[273], self.tags[279])
        out = np.empty((r1 - r0, c1 - c0), self.dtype)
        for br in range(r0 // bh, -(-r1 // bh)):
            for bc in range(c0 // bw, -(-c1 // bw)):
                k, high = br * across + bc, bh if tiled else min(bh, h - br * bh)
                part = self._decode(self.data[starts[k] : starts[k] + sizes[k]], high, bw)
                a, b, c, d = max(r0, br * bh), min(r1, br * bh + high), max(c0, bc * bw), min(c1, (bc + 1) * bw)
                out[a - r0 : b - r0, c - c0 : d - c0] = part[a - br * bh : b - br * bh, c - bc * bw : d - bc * bw]
        return r0, c0, out

    def _decode(self, raw: bytes, height: int, width: int) -> np.ndarray:
        way, ahead = self.one(259, 1), self.one(317, 1)
        if way in (8, 32946):
            raw = zlib.decompress(raw)
        elif way != 1:
            raise ValueError(f"compression {way} isn't read")
        if self.one(277, 1) != 1 or ahead not in (1, 2) or ahead == 2 and self.dtype.kind == "f":
            raise ValueError("only single bands, plain or with horizontal differences, are read")
        part = np.frombuffer(raw, self.dtype, height * width).reshape(height, width)
        return np.cumsum(part, axis=1, dtype=self.dtype) if ahead == 2 else part


def problem_of(raster: Raster) -> str | None:
    """Why a raster isn't laid out for reading by windows: larger than a tile without tiles or without overviews,
    overviews that don't shrink, or cells whose place on the ground is unknown."""
    large = max(raster.one(256), raster.one(257)) > 512
    if large and 322 not in raster.tags:
        return "not_tiled"
    if large and not raster.overviews:
        return "no_overviews"
    sizes = [raster.one(256), *raster.overviews]
    if any(a <= b for a, b in zip(sizes, sizes[1:], strict=False)):
        return "overviews_not_smaller"
    return None if {33550, 33922} <= set(raster.tags) else "no_georeference"


def files(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """path, content of the raster files below a folder."""
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def headers(rasters: DataFrame) -> DataFrame:
    """A row a file: size, cell type, place, blocks, number of overviews; `problem` for what can't be read."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row: dict = {"path": path}
                try:
                    r = Raster.open(content)
                    at, cell = r.tags.get(33922, (None,) * 6), r.tags.get(33550, (None, None))
                    row |= {"width": r.one(256), "height": r.one(257), "dtype": r.dtype.name, "epsg": r.epsg, "left": at[3], "top": at[4], "resolution": list(cell[:2]), "nodata": r.nodata, "block": list(r.block), "overviews": len(r.overviews), "problem": problem_of(r)}
                except (ValueError, KeyError, struct.error, IndexError) as e:
                    row["problem"] = f"unreadable: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, pa.schema(_SCHEMA))

    return rasters.select("path", "content").mapInArrow(run, HEADER)


_SCHEMA = [
    ("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("dtype", pa.string()), ("epsg", pa.int32()), ("left", pa.float64()), ("top", pa.float64()),
    ("resolution", pa.list_(pa.float64())), ("nodata", pa.float64()), ("block", pa.list_(pa.int32())), ("overviews", pa.int32()), ("problem", pa.string()),
]


def windows(rasters: DataFrame, bounds: tuple[float, float, float, float] | None = None, pad: int = 4) -> DataFrame:
    """path, row, col, value of the cells of each file that meet bounds (left, bottom, right, top) in the file's own
    coordinates, with `pad` cells more on each side; of all cells without bounds. Missing cells have a NULL value."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = Raster.open(content)
                row, col, height, width = 0, 0, r.one(257), r.one(256)
                if bounds:
                    (_, _, _, left, top, _), (dx, dy, *_) = r.tags[33922], r.tags[33550]
                    col, row = round((bounds[0] - left) / dx) - pad, round((top - bounds[3]) / dy) - pad
                    width, height = round((bounds[2] - bounds[0]) / dx) + 2 * pad, round((bounds[3] - bounds[1]) / dy) + 2 * pad
                r0, c0, values = r.window(row, col, height, width)
                for k in range(0, len(values), 256):
                    part = values[k : k + 256].astype(np.float64)
                    rows, cols = np.indices(part.shape)
                    flat = part.ravel()
                    lost = ~np.isfinite(flat) | (flat == r.nodata if r.nodata is not None else False)
                    columns = [pa.array([path] * len(flat)), pa.array((rows.ravel() + r0 + k).astype(np.int32)), pa.array((cols.ravel() + c0).astype(np.int32)), pa.array(flat, mask=lost)]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "row", "col", "value"])

    return rasters.select("path", "content").mapInArrow(run, "path string, row int, col int, value double")
