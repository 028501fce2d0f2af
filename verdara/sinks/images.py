"""Pixel tables to image files: PNG previews and tiled, deflated GeoTIFF rasters.

One image is one group of `applyInArrow`, so its size is that of an analysis's grid (bounded by the area limit),
not of the data; images of different acquisitions are made in parallel. The bytes are returned as rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdara.session import ship

# The raster's marker of missing cells.
NODATA = -9999.0
TILE = 256


def png(image: np.ndarray) -> bytes:
    """PNG file of a (height, width, 3 or 4) array of bytes."""
    h, w, depth = image.shape
    lines = np.zeros((h, 1 + w * depth), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = image.reshape(h, w * depth)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[depth], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + chunk(b"IEND", b"")


def _levels(values: np.ndarray) -> list[np.ndarray]:
    """The raster and its overviews, each of every second cell of the one before, until one tile holds it."""
    out = [values]
    while max(out[-1].shape) > TILE:
        out.append(out[-1][::2, ::2])
    return out


def geotiff(values: np.ndarray, left: float, top: float, resolution: float, epsg: int) -> bytes:
    """Tiled float32 GeoTIFF, deflated, with NaN as the nodata value, and overviews.

    All directories come first, the full raster's before its overviews'; of the tiles, those of the smallest
    overview come first, so that a reader gets a small picture from the file's beginning.
    """
    long, short, double, text = ("I", 4), ("H", 3), ("d", 12), ("s", 2)
    keys = [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg]
    levels = []
    for number, level in enumerate(_levels(values)):
        h, w = level.shape
        down, across = -(-h // TILE), -(-w // TILE)
        full = np.full((down * TILE, across * TILE), NODATA, "<f4")
        full[:h, :w] = np.where(np.isfinite(level), level, NODATA)
        tiles = [zlib.compress(full[r * TILE : (r + 1) * TILE, c * TILE : (c + 1) * TILE].tobytes(), 6) for r in range(down) for c in range(across)]
        tags = [(254, long, [1])] if number else []
        tags += [
            (256, long, [w]), (257, long, [h]), (258, short, [32]), (259, short, [8]), (262, short, [1]), (277, short, [1]), (284, short, [1]),
            (322, short, [TILE]), (323, short, [TILE]), (324, long, [0] * len(tiles)), (325, long, [len(t) for t in tiles]), (339, short, [3]),
        ]
        if not number:
            tags += [(33550, double, [resolution, resolution, 0.0]), (33922, double, [0.0, 0.0, 0.0, left, top, 0.0]), (34735, short, keys)]
        levels.append(([*tags, (42113, text, f"{NODATA:g}\0".encode())], tiles))

    def body(kind, v) -> bytes:
        return v if kind is text else struct.pack(f"<{len(v)}{kind[0]}", *v)

    def directory(tags: list, start: int, tile_starts: list[int], follows: bool) -> bytes:
        """A directory that begins at `start` of the file; the next one stands right behind it."""
        at = start + 2 + 12 * len(tags) + 4
        entries, far = b"", b""
        for tag, kind, v in tags:
            data = body(kind, tile_starts if tag == 324 else v)
            if len(data) <= 4:
                held = data.ljust(4, b"\0")
            else:
                held = struct.pack("<I", at + len(far))
                far += data + b"\0" * (len(data) % 2)
            entries += struct.pack("<HHI", tag, kind[1], len(v)) + held
        return struct.pack("<H", len(tags)) + entries + struct.pack("<I", at + len(far) if follows else 0) + far

    sizes = [len(directory(tags, 0, [0] * len(tiles), False)) for tags, tiles in levels]
    at, starts = 8 + sum(sizes), {}
    for k in reversed(range(len(levels))):
        starts[k] = []
        for t in levels[k][1]:
            starts[k].append(at)
            at += len(t)
    heads = b"".join(directory(tags, 8 + sum(sizes[:k]), starts[k], k + 1 < len(levels)) for k, (tags, _) in enumerate(levels))
    return b"II*\0" + struct.pack("<I", 8) + heads + b"".join(t for k in reversed(range(len(levels))) for t in levels[k][1])


def _image_rows(pixels: DataFrame, key: str, columns: list[str], make) -> DataFrame:
    ship(pixels.sparkSession)
    kind = dict(pixels.dtypes)[key]

    def run(group, table):
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        got = make(row, col, {c: table.column(c).to_numpy(zero_copy_only=False) for c in columns})
        return pa.table({key: table.column(key).slice(0, 1), "content": pa.array([got], pa.binary())})

    return pixels.select(key, "row", "col", *columns).groupBy(key).applyInArrow(run, f"{key} {kind}, content binary")


def png_images(pixels: DataFrame, key: str = "acquisition") -> DataFrame:
    """(key, content): PNG of each acquisition's (row, col, r, g, b, alpha); cells without a row are transparent.

    Rows and columns are taken relative to the least ones; a decimated table must be renumbered first.
    """

    def make(row, col, bands):
        out = np.zeros((row.max() - row.min() + 1, col.max() - col.min() + 1, 4), np.uint8)
        for k, name in enumerate(("r", "g", "b", "alpha")):
            out[row - row.min(), col - col.min(), k] = bands[name]
        return png(out)

    return _image_rows(pixels, key, ["r", "g", "b", "alpha"], make)


def geotiff_rasters(pixels: DataFrame, width: int, height: int, left: float, top: float, resolution: float, epsg: int, key: str = "acquisition", value: str = "ndvi") -> DataFrame:
    """(key, content): GeoTIFF of each acquisition's (row, col, value) on the grid; missing cells are nodata."""

    def make(row, col, bands):
        out = np.full((height, width), np.nan, np.float32)
        out[row, col] = bands[value].astype(np.float32)
        return geotiff(out, left, top, resolution, epsg)

    return _image_rows(pixels, key, [value], make)
