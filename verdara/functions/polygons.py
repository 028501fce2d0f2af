"""Polygons with holes as Column math: exact cover, union and intersection by slabs, and areas along geodesics.

A polygon is an array of rings, ARRAY<ARRAY<STRUCT<x, y>>>, closed or not, under the even-odd rule: outlines, holes
and the parts of a multipolygon stand side by side. Coordinates are degrees.

Cover. Every corner's latitude, and that of every crossing of two sides, cuts the plane into slabs in which no two sides
cross. A scan line meets the sides in order, so what it has in common with the area and with any of the footprints is
a sum of intervals, and that length is linear inside a slab: two scan lines give it, and its integral over the ellipsoid's
latitudes follows by quadrature. Nothing is sampled. Cost goes with the square of a row's sides, not with the table.

Geodesics. A side is the shortest way between its corners. The inverse problem is Vincenty's fixed point, as a fold; the
area under a side is the integral of the zonal area along it, by Gauss quadrature in panels.

Defined cases: NULL or empty footprints cover nothing; an area without extent gives 0; rings of fewer than three corners
have no area; nearly antipodal corners of one side have no certain shortest way (NaN or a wrong side may come of it).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdara.functions.geo import A, E, E2, FLATTENING, let
from verdara.functions.projection import _edges

#: Gauss-Legendre nodes and weights of five points on (0, 1).
_R = [math.sqrt(5 - 2 * math.sqrt(10 / 7)) / 3, math.sqrt(5 + 2 * math.sqrt(10 / 7)) / 3]
_W = [(322 + 13 * math.sqrt(70)) / 1800, (322 - 13 * math.sqrt(70)) / 1800]
GAUSS = [(0.5, 64 / 225)] + [(0.5 + s * r / 2, w) for r, w in zip(_R, _W, strict=True) for s in (-1, 1)]
PANELS, ROUNDS = 8, 14


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _sides(rings: Column) -> Column:
    """Sides of all rings but those without length, as the closing one of a closed ring."""
    sides = F.flatten(F.transform(F.coalesce(rings, F.array().cast("array<array<struct<x:double,y:double>>>")), _edges))
    return F.filter(sides, lambda e: e["p"] != e["q"])


def _crossing_y(e: Column, f: Column) -> Column:
    """Latitude at which two sides cross; NULL if they don't or lie in one direction."""
    ex, ey, fx, fy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"], f["q"]["x"] - f["p"]["x"], f["q"]["y"] - f["p"]["y"]
    dx, dy = f["p"]["x"] - e["p"]["x"], f["p"]["y"] - e["p"]["y"]
    turn = F.nullif(ex * fy - ey * fx, F.lit(0.0))
    t, u = (dx * fy - dy * fx) / turn, (dx * ey - dy * ex) / turn
    return F.when(t.between(0, 1) & u.between(0, 1), e["p"]["y"] + t * ey)


def _covered(cuts: Column) -> Column:
    """Length of a scan line inside the first polygon and any of the others; cuts: the sorted places where each is crossed."""
    inside = lambda own, x: F.size(F.filter(own, lambda v: v < x)) % 2 == 1
    own = F.array_sort(F.flatten(cuts))

    def part(x: Column, i: Column) -> Column:
        def width(after: Column) -> Column:
            middle = (x + after) / 2
            both = inside(cuts[0], middle) & F.exists(F.slice(cuts, F.lit(2), F.size(cuts)), lambda c: inside(c, middle))
            return F.when(both, after - x).otherwise(0.0)

        return F.coalesce(width(F.get(own, i + 1)), F.lit(0.0))

    return _sum(F.transform(own, part))


def _meridional(lat: Column) -> Column:
    """Area of the ellipsoid per radian of longitude and degree of latitude."""
    sin = F.sin(F.radians(lat))
    return A * A * (1 - E2) * F.cos(F.radians(lat)) * math.pi / 180 / F.pow(1 - E2 * sin * sin, 2)


def _cuts(sides: Column, y: Column) -> Column:
    """Where a scan line is crossed, in order."""
    cross = F.filter(sides, lambda e: (e["p"]["y"] > y) != (e["q"]["y"] > y))
    return F.array_sort(F.transform(cross, lambda e: (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]))


def _levels(sides: Column, low: Column, high: Column) -> Column:
    """Latitudes from `low` to `high` between which no two sides cross; a side looks at those after it only."""
    after = lambda i: F.slice(sides, i + 2, F.size(sides))
    crossings = F.flatten(F.transform(sides, lambda e, i: F.array_compact(F.transform(after(i), lambda f: _crossing_y(e, f)))))
    corners = F.transform(sides, lambda e: e["p"]["y"])
    return F.filter(F.array_sort(F.array_distinct(F.concat(corners, crossings))), lambda y: y.between(low, high))


def _by_slabs(levels: Column, length: Callable[[Column], Column]) -> Column:
    """Integral over the ellipsoid's latitudes of `length(y)`, degrees of longitude, linear between levels."""

    def slab(y: Column, i: Column, ys: Column) -> Column:
        top = F.get(ys, i + 1)
        scan = lambda t: length(y + t * (top - y))

        def integral(ends: Column) -> Column:
            rise = 2 * (ends[1] - ends[0])
            return (top - y) * sum(w * (ends[0] + rise * (t - 0.25)) * _meridional(y + t * (top - y)) for t, w in GAUSS)

        return F.when(top > y, let(F.array(scan(0.25), scan(0.75)), integral)).otherwise(0.0)

    km2 = let(levels, lambda ys: _sum(F.transform(ys, lambda y, i: slab(y, i, ys)))) * math.pi / 180 / 1e6
    return F.coalesce(km2, F.lit(0.0))


def _reach(sides: Column) -> tuple[Column, Column]:
    return tuple(pick(F.transform(sides, lambda e: e["p"]["y"])) for pick in (F.array_min, F.array_max))


def cover_km2(area: Column, footprints: Column) -> Column:
    """Ellipsoidal area of what the area has in common with the union of footprints; sides are straight in degrees."""
    polygons = F.concat(F.array(area), F.coalesce(footprints, F.array().cast("array<array<array<struct<x:double,y:double>>>>")))

    def over(sides: Column) -> Column:
        levels = let(F.flatten(sides), lambda flat: _levels(flat, *_reach(sides[0])))
        return _by_slabs(levels, lambda y: let(F.transform(sides, lambda s: _cuts(s, y)), _covered))

    return let(F.transform(polygons, _sides), over)


def area_km2(rings: Column) -> Column:
    """Ellipsoidal area of a polygon with holes; sides are straight in degrees.

    Of a scan line's sorted crossings each second one ends what lies inside, so signs that alternate sum it up.
    """
    inside = lambda cuts: _sum(F.transform(cuts, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)))
    return let(_sides(rings), lambda sides: _by_slabs(_levels(sides, *_reach(sides)), lambda y: let(_cuts(sides, y), inside)))


def coverage_pct(area: Column, footprints: Column) -> Column:
    """Percent of an area (a polygon) that the union of footprints (an array of polygons) covers; 0 for an area without extent."""
    share = F.try_divide(100 * cover_km2(area, footprints), F.nullif(area_km2(area), F.lit(0.0)))
    return F.least(F.coalesce(share, F.lit(0.0)), F.lit(100.0))


def overlap_pct(area: Column, footprint: Column) -> Column:
    """Percent of a polygon's area that another one, of any shape, covers."""
    return coverage_pct(area, F.array(footprint))


def _zonal(sin: Column) -> Column:
    """Area between the equator and the latitude of this sine, per radian of longitude."""
    return A * A * (1 - E2) / 2 * (sin / (1 - E2 * sin * sin) + F.atanh(E * sin) / E)


#: Half of the ellipsoid.
HEMISPHERE = math.pi * A * A * (1 + (1 - E2) * math.atanh(E) / E)


def _turn(e: Column) -> Column:
    """Degrees of longitude from a side's first corner to its second, the short way round."""
    return F.pmod(e["q"]["x"] - e["p"]["x"] + 180, F.lit(360.0)) - 180


def _under(e: Column) -> Column:
    """Area between the equator and the geodesic along a side, positive eastward."""
    reduced = lambda p: F.atan((1 - FLATTENING) * F.tan(F.radians(p["y"])))

    def arc(s: Column, omega: Column) -> Column:
        """Sines and cosines of the arc, and the sine of the azimuth at the equator, on the auxiliary sphere."""
        x, y = s["c2"] * F.sin(omega), s["c1"] * s["s2"] - s["s1"] * s["c2"] * F.cos(omega)
        sin = F.sqrt(x * x + y * y)
        cos = s["s1"] * s["s2"] + s["c1"] * s["c2"] * F.cos(omega)
        tilt = F.coalesce(s["c1"] * x / F.nullif(sin, F.lit(0.0)), F.lit(0.0))
        return F.struct(sin.alias("sin"), cos.alias("cos"), tilt.alias("tilt"), x.alias("x"), y.alias("y"))

    def better(s: Column, omega: Column) -> Column:
        def step(a: Column) -> Column:
            flat = 1 - a["tilt"] * a["tilt"]
            c = FLATTENING / 16 * flat * (4 + FLATTENING * (4 - 3 * flat))
            m = F.coalesce(a["cos"] - 2 * s["s1"] * s["s2"] / F.nullif(flat, F.lit(0.0)), F.lit(0.0))
            return s["turn"] + (1 - c) * FLATTENING * a["tilt"] * (F.atan2(a["sin"], a["cos"]) + c * a["sin"] * (m + c * a["cos"] * (2 * m * m - 1)))

        return let(arc(s, omega), step)

    def integral(s: Column, a: Column) -> Column:
        # The arc starts at `first` from the node and is `long`; (x, y) is the direction at its start.
        direction = F.atan2(a["x"], a["y"])
        first, long = F.atan2(s["s1"], F.cos(direction) * s["c1"]), F.atan2(a["sin"], a["cos"])

        def panel(b: Column) -> Column:
            def area(k: Column) -> Column:
                def node(t: float) -> Column:
                    sine = F.sqrt(F.greatest(1 - a["tilt"] * a["tilt"], F.lit(0.0))) * F.sin(b["first"] + b["long"] * (k + t) / PANELS)
                    return let(sine * sine, lambda q: _zonal(sine / F.sqrt(q + (1 - FLATTENING) ** 2 * (1 - q))) * F.sqrt(1 - E2 * (1 - q)) / (1 - q))

                return sum(w * node(t) for t, w in GAUSS)

            return b["long"] / PANELS * a["tilt"] * _sum(F.transform(F.sequence(F.lit(0), F.lit(PANELS - 1)), area))

        return let(F.struct(first.alias("first"), long.alias("long")), panel)

    def whole(s: Column) -> Column:
        omega = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), s["turn"], lambda w, _: better(s, w))
        # Along a meridian longitude changes at a pole only, where the side begins, ends or passes over.
        pole = s["turn"] * F.signum(s["s1"] + s["s2"]) * HEMISPHERE / (2 * math.pi)
        return let(let(omega, lambda w: arc(s, w)), lambda a: F.when(F.abs(a["tilt"]) < 1e-10, pole).otherwise(integral(s, a)))

    b1, b2 = reduced(e["p"]), reduced(e["q"])
    start = F.struct(F.sin(b1).alias("s1"), F.cos(b1).alias("c1"), F.sin(b2).alias("s2"), F.cos(b2).alias("c2"), F.radians(_turn(e)).alias("turn"))
    return let(start, whole)


def geodesic_ring_km2(ring: Column) -> Column:
    """Area of a ring in degrees whose sides are geodesics, whatever its direction; of a ring around a pole, the pole's side."""
    total = let(_edges(ring), lambda sides: F.struct(_sum(F.transform(sides, _under)).alias("under"), _sum(F.transform(sides, _turn)).alias("round")))
    area = let(total, lambda t: F.when(F.abs(t["round"]) > 180, HEMISPHERE - F.abs(t["under"])).otherwise(F.abs(t["under"])))
    return F.when(F.size(ring) >= 3, area / 1e6).otherwise(0.0)


def geodesic_area_km2(parts: Column) -> Column:
    """Area of the parts of a multipolygon, each an outline and its holes, along geodesics."""
    own = lambda rings: 2 * geodesic_ring_km2(rings[0]) - _sum(F.transform(rings, geodesic_ring_km2))
    return F.coalesce(_sum(F.transform(parts, own)), F.lit(0.0))


_MULTI = "type string, coordinates array<array<array<array<double>>>>"
_SINGLE = "type string, coordinates array<array<array<double>>>"


def geojson_parts(text: Column) -> Column:
    """Parts of a GeoJSON Polygon or MultiPolygon, each an outline and its holes; NULL for other text or broken rings.

    Rings need four positions of two numbers, and close where they begin.
    """
    return let(text, lambda t: let(_parts(t), _sound_parts))


def _parts(text: Column) -> Column:
    kind = F.get_json_object(text, "$.type")
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, _SINGLE)["coordinates"])).when(kind == "MultiPolygon", F.from_json(text, _MULTI)["coordinates"])
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    return F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, point)))


def _sound_parts(made: Column) -> Column:
    """The parts if all of them are whole, else NULL."""
    sound = lambda r: (F.size(r) >= 4) & F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull()) & (F.element_at(r, 1) == F.element_at(r, -1))
    whole = F.forall(made, lambda part: (F.size(part) > 0) & F.forall(part, sound))
    return F.when((F.size(made) > 0) & F.coalesce(whole, F.lit(False)), made)


def outlines(parts: Column) -> Column:
    """A multipolygon's parts as one polygon under the even-odd rule."""
    return F.flatten(parts)
