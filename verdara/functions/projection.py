"""Projection, rings and polygons as Column math: no Python runs for a row.

A ring is ARRAY<STRUCT<x, y>> of doubles, closed or not. Edges are straight in the ring's own coordinates. Areas,
cover and GeoJSON are in `polygons`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdara.functions.geo import A, E, FLATTENING, let

RING = "array<struct<x:double,y:double>>"

_N = FLATTENING / (2 - FLATTENING)
#: Radius of the rectifying sphere, and the coefficients of the transverse Mercator series to the fourth order.
RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
SERIES = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
K0, EASTING, SOUTHING = 0.9996, 500_000.0, 10_000_000.0


def utm_xy(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing in the UTM zone that `epsg` (326zz or 327zz) names; NULL when an input is."""
    return _eastings(*_sphere(lon, lat, epsg), epsg)


def _sphere(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    turn, sin = F.radians(lon - (epsg % 100 * 6 - 183)), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin) - E * F.atanh(E * sin))
    return F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))


def _eastings(xi: Column, eta: Column, epsg: Column) -> tuple[Column, Column]:
    up, right = xi, eta
    for j, c in enumerate(SERIES, 1):
        up += c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        right += c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return EASTING + K0 * RADIUS * right, K0 * RADIUS * up + F.when(epsg >= 32700, SOUTHING).otherwise(0.0)


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def ring_utm(ring: Column, epsg: Column) -> Column:
    """`utm_xy` of each corner, by small steps that are computed once."""
    place = lambda p: let(_point(*_sphere(p["x"], p["y"], epsg)), lambda s: _point(*_eastings(s["x"], s["y"], epsg)))
    return F.transform(ring, place)


def bbox_ring(w: Column, s: Column, e: Column, n: Column) -> Column:
    """The bbox's corners, counter-clockwise from the south-west, closed."""
    corners = [(w, s), (e, s), (e, n), (w, n), (w, s)]
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


def _edges(ring: Column) -> Column:
    """ARRAY<STRUCT<p, q>> of a ring's sides; the closing side of an open ring comes last."""
    turned = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in the ring, by the parity of the sides to its right."""

    def crossing(e: Column) -> Column:
        p, q = e["p"], e["q"]
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
        return F.coalesce(((p["y"] > y) != (q["y"] > y)) & (x < at), F.lit(False))

    return F.size(F.filter(_edges(ring), crossing)) % 2 == 1


def rasterize(rings: DataFrame, ring: str, width: int, height: int, resolution: float, left: Column, top: Column) -> DataFrame:
    """Adds row, col, in_aoi for each cell of the grid below (left, top); a cell is in when its centre is."""
    cells = rings.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    x, y = left + (F.col("col") + 0.5) * resolution, top - (F.col("row") + 0.5) * resolution
    return cells.withColumn("in_aoi", contains(F.col(ring), x, y))


#: Coefficients of the inverse series: of the rectifying sphere, and of the latitude.
INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def lonlat(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a point of the UTM zone that `epsg` names."""
    xi, eta = _unseries(*_scaled(x, y, epsg))
    return _degrees(xi, eta, _conformal(xi, eta), epsg)


def _scaled(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    return (y - F.when(epsg >= 32700, SOUTHING).otherwise(0.0)) / (K0 * RADIUS), (x - EASTING) / (K0 * RADIUS)


def _unseries(up: Column, right: Column) -> tuple[Column, Column]:
    xi, eta = up, right
    for j, c in enumerate(INVERSE, 1):
        xi -= c * F.sin(2 * j * up) * F.cosh(2 * j * right)
        eta -= c * F.cos(2 * j * up) * F.sinh(2 * j * right)
    return xi, eta


def _conformal(xi: Column, eta: Column) -> Column:
    return F.asin(F.sin(xi) / F.cosh(eta))


def _degrees(xi: Column, eta: Column, chi: Column, epsg: Column) -> tuple[Column, Column]:
    lat = chi
    for j, c in enumerate(LATITUDE, 1):
        lat += c * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + ((epsg % 100) * 6 - 183), F.degrees(lat)


def with_lonlat(frame: DataFrame, xs: Sequence[str], ys: Sequence[str], epsg: Column) -> DataFrame:
    """Adds `lonlat` of the points where the columns `xs` and `ys` meet, as _<x>_<y>_lon and _<x>_<y>_lat.

    Each step is a column of its own: Spark compiles columns, and walks through lambdas node by node.
    """
    c = F.col
    meet = {f"_{x}_{y}": (f"_{x}_scaled", f"_{y}_scaled") for x in xs for y in ys}
    right = {f"_{x}_scaled": _scaled(c(x), c(ys[0]), epsg)[1] for x in xs}
    out = frame.withColumns(right | {f"_{y}_scaled": _scaled(c(xs[0]), c(y), epsg)[0] for y in ys})

    def step(out: DataFrame, made: dict[str, tuple[Column, Column]], first: str, second: str) -> DataFrame:
        return out.withColumns({k + end: v for k, pair in made.items() for end, v in zip((first, second), pair, strict=True)})

    out = step(out, {k: _unseries(c(y), c(x)) for k, (x, y) in meet.items()}, "_xi", "_eta")
    out = out.withColumns({f"{k}_chi": _conformal(c(f"{k}_xi"), c(f"{k}_eta")) for k in meet})
    out = step(out, {k: _degrees(c(f"{k}_xi"), c(f"{k}_eta"), c(f"{k}_chi"), epsg) for k in meet}, "_lon", "_lat")
    return out.drop(*[f"_{k}_scaled" for k in (*xs, *ys)], *[k + end for k in meet for end in ("_xi", "_eta", "_chi")])


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Centre of a ring's area; of its corners, if it has no area."""
    centre = ring_middle(ring)
    return centre["x"], centre["y"]


def ring_middle(ring: Column) -> Column:
    """`ring_centroid` as a struct: the ring, and each of its sides, is computed once."""
    none = F.struct(*[F.lit(0.0).alias(k) for k in ("twice", "x", "y")])

    def add(sums: Column, e: Column) -> Column:
        p, q = e["p"], e["q"]
        moved = lambda cross: F.struct((sums["twice"] + cross).alias("twice"), *[(sums[k] + (p[k] + q[k]) * cross).alias(k) for k in ("x", "y")])
        return let(p["x"] * q["y"] - q["x"] * p["y"], moved)

    def middle(r: Column) -> Column:
        mean = lambda k: F.aggregate(F.transform(r, lambda p: p[k]), F.lit(0.0), lambda a, v: a + v) / F.size(r)
        return let(F.aggregate(_edges(r), none, add), lambda m: _point(*[F.coalesce(m[k] / (3 * F.nullif(m["twice"], F.lit(0.0))), mean(k)) for k in ("x", "y")]))

    return let(ring, middle)


def ring_problem(ring: Column) -> Column:
    """Why a ring can't be an area of interest: too few corners, no area, or two sides that cross; NULL if it can."""
    sides = _edges(ring)
    turn = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    apart = lambda e, f: (F.signum(turn(e["p"], e["q"], f["p"])) * F.signum(turn(e["p"], e["q"], f["q"])) < 0) & (F.signum(turn(f["p"], f["q"], e["p"])) * F.signum(turn(f["p"], f["q"], e["q"])) < 0)
    twice = F.aggregate(F.transform(sides, lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]), F.lit(0.0), lambda a, v: a + v)
    crossed = F.exists(sides, lambda e: F.exists(sides, lambda f: apart(e, f)))
    return F.when(ring.isNull() | (F.size(F.array_distinct(ring)) < 3), "too_few_points").when(crossed, "self_intersection").when(twice == 0, "no_area")


def crossings(ring: Column, y: Column) -> Column:
    """Where the ring's sides cross the horizontal line at y; a point of that line is inside if an odd number lie right of it."""

    def at(e: Column) -> Column:
        p, q = e["p"], e["q"]
        x = (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
        return F.when((p["y"] > y) != (q["y"] > y), x)

    return F.array_compact(F.transform(_edges(ring), at))
