"""Polygon cover, geodesic areas and GeoJSON with holes against independent sums and published values."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from verdara.functions import geo, polygons
from verdara.plans import geometry_queries

POLYGON = "array<array<struct<x:double,y:double>>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(w, s, e, n):
    return [ring([(w, s), (e, s), (e, n), (w, n), (w, s)])]


def zonal(lat):
    s = math.sin(math.radians(lat))
    return geo.A**2 * (1 - geo.E2) / 2e6 * (s / (1 - geo.E2 * s * s) + math.atanh(geo.E * s) / geo.E)


def covered(area, prints):
    """km2 of the area that any footprint covers, by slabs of longitude: the code takes slabs of latitude."""
    sides = [[(p, q) for r in poly for p, q in zip(r, r[1:] + r[:1], strict=True)] for poly in ([[(p["x"], p["y"]) for p in r] for r in g] for g in (area, *prints))]
    flat = [s for own in sides for s in own]
    cuts = {p[0] for p, _ in flat}
    for (ax, ay), (bx, by) in flat:
        for (cx, cy), (dx, dy) in flat:
            turn = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if turn:
                t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / turn, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / turn
                if 0 <= t <= 1 and 0 <= u <= 1:
                    cuts.add(ax + t * (bx - ax))
    cuts, total = sorted(cuts), 0.0
    for x0, x1 in zip(cuts, cuts[1:], strict=False):
        for t, w in polygons.GAUSS:
            x = x0 + t * (x1 - x0)
            at = sorted((ay + (x - ax) * (by - ay) / (bx - ax), k) for k, own in enumerate(sides) for (ax, ay), (bx, by) in own if (ax > x) != (bx > x))
            odd = [False] * len(sides)
            for (y, k), (up, _) in zip(at, at[1:], strict=False):
                odd[k] = not odd[k]
                if odd[0] and any(odd[1:]):
                    total += w * math.radians(x1 - x0) * (zonal(up) - zonal(y))
    return total


def test_cover_of_random_rings(spark):
    rng = random.Random(1)
    corner = lambda: (rng.uniform(0, 3), rng.uniform(40, 43))
    table = []
    for _ in range(40):
        area = [ring([corner() for _ in range(rng.randint(3, 7))]) for _ in range(rng.randint(1, 2))]
        table.append((area, [[ring([corner() for _ in range(rng.randint(3, 6))])] for _ in range(rng.randint(0, 3))]))
    # Touching, equal and nested ones; shared sides; a hole that a footprint fills in part.
    table += [(box(0, 40, 2, 42), [box(0, 40, 1, 42), box(1, 40, 2, 42)]), (box(0, 40, 2, 42), [box(0, 40, 2, 42)] * 2), (box(0, 40, 2, 42) + box(0.5, 40.5, 1, 41), [box(0.75, 40, 3, 41.5)])]
    frame = spark.createDataFrame(table, f"a {POLYGON}, f array<{POLYGON}>")
    got = frame.select(polygons.cover_km2(F.col("a"), F.col("f")), polygons.area_km2(F.col("a"))).collect()
    for (area, prints), (part, whole) in zip(table, got, strict=True):
        assert part == pytest.approx(covered(area, prints), rel=1e-9, abs=1e-6)
        assert whole == pytest.approx(covered(area, [area]), rel=1e-9, abs=1e-6)


def test_area_of_rings_that_touch_and_cross(spark):
    """Even-odd: equal rings cancel, shared sides and repeated corners count for nothing."""
    twice, beside, cross = box(0, 40, 2, 42) * 2, box(0, 40, 1, 42) + box(1, 40, 2, 42), [ring([(0, 40), (2, 42), (2, 40), (0, 42)])]
    stutter = [ring([(0, 40), (0, 40), (2, 40), (2, 42), (2, 42), (0, 42), (0, 40)])]
    table = [(g,) for g in (twice, beside, cross, stutter, box(0, 40, 2, 42), None, [], [ring([(1, 1)] * 4)])]
    got = [r[0] for r in spark.createDataFrame(table, f"a {POLYGON}").select(polygons.area_km2(F.col("a"))).collect()]
    want = math.radians(2) * (zonal(42) - zonal(40))
    assert got[0] == pytest.approx(0, abs=1e-6) and got[5:] == [0.0] * 3
    assert [got[k] for k in (1, 3, 4)] == [pytest.approx(want, rel=1e-12)] * 3 and got[2] == pytest.approx(covered(cross, [cross]), rel=1e-9)


def test_areas_of_geojson_are_made_by_many_tasks(spark):
    made = geometry_queries.geojson_area(spark, f"{DATA}/sf0.001")
    assert made.groupBy(F.spark_partition_id()).count().count() > 4


def test_coverage_decides_at_the_gate(spark):
    """A strip of 0.8 % that nobody covers is 0.8 %, however thin."""
    table = [(box(0, 40, 1, 41), [box(0, 40, 1 - gap, 41)]) for gap in (0.0075, 0.008, 0.00001)] + [(box(0, 40, 1, 41), None), (box(0, 40, 1, 41), []), ([], [box(0, 0, 1, 1)]), (None, [box(0, 0, 1, 1)]), (box(1, 1, 1, 1), [box(0, 0, 2, 2)]), ([ring([(0, 0), (1, 1)])], [box(0, 0, 1, 1)])]
    got = [r[0] for r in spark.createDataFrame(table, f"a {POLYGON}, f array<{POLYGON}>").select(polygons.coverage_pct(F.col("a"), F.col("f"))).collect()]
    assert got[:3] == [pytest.approx(v, abs=1e-9) for v in (99.25, 99.2, 99.999)] and got[3:] == [0.0] * 6


def test_geodesic_areas(spark):
    # A published polygon of 18 geodesics around the South Pole, and its area in square metres.
    points = [(-58, -63.1), (-74, -72.9), (-102, -71.9), (-102, -74.9), (-131, -74.3), (-163, -77.5), (163, -77.4), (172, -71.7), (140, -65.9), (113, -65.7), (88, -66.6), (59, -66.9), (25, -69.8), (-4, -70.0), (-14, -71.0), (-33, -77.3), (-46, -77.9), (-61, -74.7)]
    octant = [(0, 0), (90, 0), (90, 90)]
    demo = box(-83.30, 42.55, -83.15, 42.65)[0]
    rings = [ring(points), ring(points[::-1]), ring(points + points[:1]), ring(octant), demo, ring([(170, 10), (-170, 10), (-170, 12), (170, 12)]), ring([(-10, 10), (10, 10), (10, 12), (-10, 12)]), ring([(0, 0), (1, 1)]), []]
    frame = spark.createDataFrame([(r,) for r in rings], "r array<struct<x:double,y:double>>")
    got = [r[0] for r in frame.select(polygons.geodesic_ring_km2(F.col("r"))).collect()]
    assert got[:3] == [pytest.approx(13662703.6800201, rel=1e-9)] * 3
    assert got[3] == pytest.approx(polygons.HEMISPHERE / 4e6, rel=1e-9)
    assert got[4] == pytest.approx(136.7476, abs=1e-3)
    assert got[5] == pytest.approx(got[6], rel=1e-12) and got[7:] == [0.0, 0.0]
    # The side along a parallel bulges poleward: more than the box of straight sides by the difference of its bulges.
    straight = spark.range(1).select(geo.bbox_area_km2(*[F.lit(float(v)) for v in (-10, 10, 10, 12)])).first()[0]
    assert 5e-4 < got[6] / straight - 1 < 0.05


def test_geojson(spark):
    square, hole = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]], [[0.2, 0.2], [0.6, 0.2], [0.6, 0.6], [0.2, 0.2]]
    good = [{"type": "Polygon", "coordinates": [square, hole]}, {"type": "MultiPolygon", "coordinates": [[square, hole], [square]]}]
    bad = [None, "", "{", '{"type":"Point","coordinates":[0,0]}', '{"type":"Polygon","coordinates":[]}', json.dumps({"type": "Polygon", "coordinates": [square[:4]]}), json.dumps({"type": "Polygon", "coordinates": [square, hole[:3]]}), json.dumps({"type": "MultiPolygon", "coordinates": [[square], []]}), '{"type":"Polygon","coordinates":[[[0,0],[1],[1,1],[0,0]]]}']
    frame = spark.createDataFrame([(json.dumps(g),) for g in good] + [(b,) for b in bad], "t string")
    parts = polygons.geojson_parts(F.col("t"))
    got = frame.select(parts.alias("p"), polygons.geodesic_area_km2(parts).alias("km2"), polygons.area_km2(polygons.outlines(parts)).alias("flat")).collect()
    assert [[len(p) for p in r["p"]] if r["p"] else None for r in got] == [[2], [2, 1]] + [None] * 9
    assert [tuple(p) for p in got[0]["p"][0][1]] == [tuple(map(float, p)) for p in hole]
    assert got[0]["km2"] == pytest.approx(got[0]["flat"], rel=1e-3) and got[0]["km2"] < 12309 * 0.93
