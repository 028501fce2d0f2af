"""Geometry in Column expressions: UTM zones, lattice snapping, bbox checks, ellipsoidal areas."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid.
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with the value computed once: plans stay small where it is used many times."""
    return F.transform(F.array(value), then)[0]


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def snap(low: Column, high: Column, resolution: float) -> tuple[Column, Column, Column]:
    """(low, high, cells): bounds moved outward to the lattice."""
    a, b = F.floor(low / resolution) * resolution, F.ceil(high / resolution) * resolution
    return a.cast("double"), b.cast("double"), ((b - a) / resolution).cast("long")


def bbox_problem(w: Column, s: Column, e: Column, n: Column) -> Column:
    """A code for the first rule that a bbox breaks; NULL if none."""
    missing = w.isNull() | s.isNull() | e.isNull() | n.isNull()
    return (
        F.when(missing, "not_finite")
        .when((w < -180) | (e > 180) | (w > 180) | (e < -180), "longitude_range")
        .when((s < -90) | (n > 90) | (s > 90) | (n < -90), "latitude_range")
        .when(w >= e, "west_not_below_east")
        .when(s >= n, "south_not_below_north")
    )


def _zonal(lat: Column) -> Column:
    """Area between the equator and a latitude per radian of longitude."""
    x = F.sin(F.radians(lat))
    return A * A * (1 - E2) / 2 * (x / (1 - E2 * x * x) + F.ln((1 + E * x) / (1 - E * x)) / (2 * E))


def bbox_area_km2(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Area of the cell between two meridians and two parallels of the ellipsoid."""
    return F.abs(F.radians(e - w) * (_zonal(n) - _zonal(s))) / 1e6


def bbox_overlap_pct(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Percent of bbox a that bbox b covers; 0 if they are apart or a is empty."""
    w, s, e, n = F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])
    part = F.when((w < e) & (s < n), bbox_area_km2(w, s, e, n)).otherwise(0.0)
    return F.coalesce(F.try_divide(100 * part, F.nullif(bbox_area_km2(*a), F.lit(0.0))), F.lit(0.0))
