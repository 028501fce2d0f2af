"""Exact polygon cover, geodesic areas, GeoJSON with holes and the spatial join over the driver tables, each with SQL by another way."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdara.functions import polygons
from verdara.functions.geo import A, E, E2, FLATTENING
from verdara.functions.projection import bbox_ring
from verdara.operators import grid, grid_cells
from verdara.plans.engine_queries import _AREA, _CORNERS, _GRID, _areas, _forward
from verdara.plans.product_queries import _SHAPE, _SIDES, _rings
from verdara.plans.queries import _t, query
from verdara.session import spread


PAD = 4 * 10.0 / 111_320.0


def zonal_sql(lat: str) -> str:
    """Area between the equator and a latitude, km2 per radian of longitude."""
    s = f"sin(radians({lat}))"
    return f"({A * A * (1 - E2) / 2e6!r}::DOUBLE * ({s} / (1 - {E2!r}::DOUBLE * {s} * {s}) + atanh({E!r}::DOUBLE * {s}) / {E!r}::DOUBLE))"


# Boxes: the union is summed over the cells that all their sides cut out, by closed form.
@query(f"""WITH b AS (SELECT n_nationkey AS k, -1.0::DOUBLE AS w, -1.0::DOUBLE AS s, 2 + n_nationkey * 0.25::DOUBLE AS e, 9.0::DOUBLE AS n FROM nation
  UNION ALL SELECT n_nationkey, 5, 2, 5 + n_nationkey * 0.15::DOUBLE, 6 FROM nation),
x AS (SELECT k, x, lead(x) OVER (PARTITION BY k ORDER BY x) AS x2 FROM (SELECT DISTINCT k, least(greatest(unnest([w, e]), 0), 10) AS x FROM b)),
y AS (SELECT k, y, lead(y) OVER (PARTITION BY k ORDER BY y) AS y2 FROM (SELECT DISTINCT k, least(greatest(unnest([s, n]), 0), 8) AS y FROM b)),
c AS (SELECT DISTINCT x.k, x, x2, y, y2 FROM x JOIN y ON x.k = y.k JOIN b ON b.k = x.k AND w < (x + x2) / 2 AND e > (x + x2) / 2 AND s < (y + y2) / 2 AND n > (y + y2) / 2 WHERE x2 > x AND y2 > y),
t AS (SELECT k, sum(radians(x2 - x) * ({zonal_sql("y2")} - {zonal_sql("y")})) AS a FROM c GROUP BY 1)
SELECT n_nationkey, round(100 * coalesce(a, 0) / (radians(10) * ({zonal_sql("8")} - {zonal_sql("0")})), 6) AS coverage_pct FROM nation LEFT JOIN t ON k = n_nationkey""")
def union_coverage(spark, d):
    k, lit = F.col("n_nationkey"), F.lit
    area = F.array(bbox_ring(lit(0.0), lit(0.0), lit(10.0), lit(8.0)))
    prints = F.array(F.array(bbox_ring(lit(-1.0), lit(-1.0), 2 + k * 0.25, lit(9.0))), F.array(bbox_ring(lit(5.0), lit(2.0), 5 + k * 0.15, lit(6.0))))
    return _t(spark, d, "nation").select("n_nationkey", F.round(polygons.coverage_pct(area, prints), 6).alias("coverage_pct"))


# Geodesics: the area under a side is summed in equal steps of longitude on the auxiliary sphere, by Simpson's rule.
_BETA = f"atan({1 - FLATTENING!r}::DOUBLE * tan(radians({{}})))"
_STEPS = 64


@query(f"WITH RECURSIVE {_SIDES[5:]}" + f""",
g AS (SELECT n_nationkey AS k, row_number() OVER () AS id, {_BETA.format("py")} AS b1, {_BETA.format("qy")} AS b2, radians(qx - px) AS turn FROM e),
r(k, id, b1, b2, turn, n, w) AS (SELECT *, 0, turn FROM g UNION ALL SELECT k, id, b1, b2, turn, n + 1, turn + (1 - c) * {FLATTENING!r}::DOUBLE * tilt * (atan2(si, co) + c * si * (m + c * co * (2 * m * m - 1))) FROM (
  SELECT *, co - 2 * sin(b1) * sin(b2) / (1 - tilt * tilt) AS m, {FLATTENING / 16!r}::DOUBLE * (1 - tilt * tilt) * (4 + {FLATTENING!r}::DOUBLE * (4 - 3 * (1 - tilt * tilt))) AS c FROM (
  SELECT *, cos(b1) * cos(b2) * sin(w) / si AS tilt FROM (
  SELECT *, sqrt((cos(b2) * sin(w)) ** 2 + (cos(b1) * sin(b2) - sin(b1) * cos(b2) * cos(w)) ** 2) AS si, sin(b1) * sin(b2) + cos(b1) * cos(b2) * cos(w) AS co FROM r WHERE n < 12)))),
p AS (SELECT k, id, w, j, atan((tan(b1) * sin(w * (1 - j / {_STEPS}.0::DOUBLE)) + tan(b2) * sin(w * (j / {_STEPS}.0::DOUBLE))) / sin(w)) AS b, CASE WHEN j IN (0, {_STEPS}) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END AS weight
  FROM r, (SELECT unnest(range({_STEPS + 1})) AS j) WHERE n = 12 AND turn <> 0),
u AS (SELECT k, w / {3 * _STEPS} * weight * sqrt(1 - {E2!r}::DOUBLE * cos(b) ** 2) * {zonal_sql(f"degrees(atan(tan(b) / {1 - FLATTENING!r}::DOUBLE))")} AS part FROM p)
SELECT k AS n_nationkey, round(abs(sum(part)), 3) AS area_km2 FROM u GROUP BY 1""")
def polygon_area(spark, d):
    return _rings(spark, d).select("n_nationkey", F.round(polygons.geodesic_ring_km2(F.col("ring")), 3).alias("area_km2"))


# A dented ring and a star beside it: slabs of longitude instead of latitude.
_STAR = ((2.0, 3.0), (6.5, 2.0), (5.5, 6.0), (9.0, 8.0), (4.0, 7.5), (3.0, 11.0))
_NODES = ", ".join(f"({t!r}::DOUBLE, {w!r}::DOUBLE)" for t, w in polygons.GAUSS)
_STARS = ", ".join(f"({p[0]}::DOUBLE, {p[1]}::DOUBLE, {q[0]}::DOUBLE, {q[1]}::DOUBLE)" for p, q in zip(_STAR, _STAR[1:] + _STAR[:1], strict=True))


@query(_SIDES + f""", star(px, py, qx, qy) AS (VALUES {_STARS}),
a AS (SELECT n_nationkey AS k, 0 AS o, px, py, qx, qy FROM e UNION ALL SELECT n_nationkey, 1, px, py, qx, qy FROM nation, star),
c AS (SELECT k, px AS x FROM a UNION SELECT k, x FROM (SELECT f.k, CASE WHEN d <> 0 AND t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 THEN apx + t * (aqx - apx) END AS x FROM (
  SELECT f.k, f.px AS apx, f.qx AS aqx, (f.qx - f.px) * (g.qy - g.py) - (f.qy - f.py) * (g.qx - g.px) AS d,
   ((g.px - f.px) * (g.qy - g.py) - (g.py - f.py) * (g.qx - g.px)) / nullif((f.qx - f.px) * (g.qy - g.py) - (f.qy - f.py) * (g.qx - g.px), 0) AS t,
   ((g.px - f.px) * (f.qy - f.py) - (g.py - f.py) * (f.qx - f.px)) / nullif((f.qx - f.px) * (g.qy - g.py) - (f.qy - f.py) * (g.qx - g.px), 0) AS u FROM a f JOIN a g ON f.k = g.k) f) WHERE x IS NOT NULL),
l AS (SELECT k, x, lead(x) OVER (PARTITION BY k ORDER BY x) AS x2 FROM c), q(t, w) AS (VALUES {_NODES}),
n AS (SELECT k, row_number() OVER () AS id, x + t * (x2 - x) AS x, w * (x2 - x) AS dx FROM l, q WHERE x2 > x),
h AS (SELECT n.k, id, dx, o, (qy - py) * (n.x - px) / (qx - px) + py AS y FROM n JOIN a ON a.k = n.k AND (px > n.x) <> (qx > n.x)),
i AS (SELECT k, id, dx, y, lead(y) OVER o AS y2, count(*) FILTER (o = 0) OVER o AS n0, count(*) FILTER (o = 1) OVER o AS n1 FROM h WINDOW o AS (PARTITION BY id ORDER BY y ROWS UNBOUNDED PRECEDING)),
z AS (SELECT k, sum(CASE WHEN n0 % 2 = 1 THEN dx * ({zonal_sql("y2")} - {zonal_sql("y")}) END) AS whole, sum(CASE WHEN n0 % 2 = 1 AND n1 % 2 = 1 THEN dx * ({zonal_sql("y2")} - {zonal_sql("y")}) END) AS part FROM i GROUP BY 1)
SELECT k AS n_nationkey, round(100 * coalesce(part, 0) / whole, 5) AS overlap_pct FROM z""")
def polygon_overlap(spark, d):
    star = F.array(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _STAR]))
    return _rings(spark, d).select("n_nationkey", F.round(polygons.overlap_pct(F.array("ring"), star), 5).alias("overlap_pct"))


# A multipolygon for each customer: a box with a hole, and a box; one in ten leaves its ring open.
@query(f"""WITH o AS (SELECT c_custkey, CAST(c_custkey * 37 % 3500 AS DOUBLE) / 10 - 179 AS x, CAST(c_custkey * 53 % 1500 AS DOUBLE) / 10 - 75 AS y FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 2 END AS parts, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 1 END AS holes, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE
  round(radians(1) * ({zonal_sql("y + 1")} - {zonal_sql("y")}) - radians(0.5) * ({zonal_sql("y + 0.5")} - {zonal_sql("y + 0.25")}) + radians(0.5) * ({zonal_sql("y + 2")} - {zonal_sql("y + 1.5")}), 4) END AS area_km2 FROM o""")
def geojson_area(spark, d):
    k = F.col("c_custkey")
    x, y = (k * 37 % 3500).cast("double") / 10 - 179, (k * 53 % 1500).cast("double") / 10 - 75

    def ring(w: float, s: float, e: float, n: float, closed: bool = True):
        corners = [(w, s), (e, s), (e, n), (w, n)] + [(w, s)] * closed
        return F.concat(F.lit("["), F.concat_ws(",", *[F.format_string("[%s,%s]", x + a, y + b) for a, b in corners]), F.lit("]"))

    outline = F.when(k % 10 == 0, ring(0, 0, 1, 1, False)).otherwise(ring(0, 0, 1, 1))
    text = F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), outline, F.lit(","), ring(0.25, 0.25, 0.75, 0.5), F.lit("],["), ring(0.5, 1.5, 1, 2), F.lit("]]}"))
    parts = spread(_t(spark, d, "customer").select("c_custkey")).select("c_custkey", polygons.geojson_parts(text).alias("parts"))
    size = lambda c: F.coalesce(c, F.lit(0))
    holes = F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p) - 1)
    area = F.when(F.col("parts").isNotNull(), polygons.area_km2(polygons.outlines(F.col("parts"))))
    return parts.select("c_custkey", size(F.when(F.col("parts").isNotNull(), F.size("parts"))).alias("parts"), size(holes).alias("holes"), F.round(F.coalesce(area, F.lit(0.0)), 4).alias("area_km2"))


# Granules of events, one in five at one place, beside the grids of customers.
@query(_GRID + f""", q AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -142.0::DOUBLE ELSE CAST(event_id * 7919 % 3600 AS DOUBLE) / 10 - 180 END AS w, CASE WHEN event_id % 5 = 0 THEN -22.0::DOUBLE ELSE CAST(event_id * 104729 % 1600 AS DOUBLE) / 10 - 80 END AS s, 0.02::DOUBLE * (1 + event_id % 97) AS size FROM events)
SELECT event_id, c_custkey FROM q JOIN n ON w <= east + {PAD!r}::DOUBLE AND w + size >= west - {PAD!r}::DOUBLE AND s <= north + {PAD!r}::DOUBLE AND s + size >= south - {PAD!r}::DOUBLE""")
def granules_on_grid(spark, d):
    k = F.col("event_id")
    w = F.when(k % 5 == 0, -142.0).otherwise((k * 7919 % 3600).cast("double") / 10 - 180)
    s = F.when(k % 5 == 0, -22.0).otherwise((k * 104729 % 1600).cast("double") / 10 - 80)
    size = 0.02 * (1 + k % 97)
    granules = _t(spark, d, "events").select("event_id", F.array(w, s, w + size, s + size).alias("bbox"))
    grids = grid.canonical_grids(_areas(spark, d)).select("c_custkey", "resolution", "bounds_geographic")
    return grid.granules_on_grid(granules, grids).select("event_id", "c_custkey")


# Small areas, one for each customer, whose cells the table function makes.
_PLOT_AREA = _AREA.replace("% 3500 AS DOUBLE) / 10 - 179", "% 3500 AS DOUBLE) / 10 - 175").replace("% 1500 AS DOUBLE) / 10 - 75", "% 1200 AS DOUBLE) / 10 - 60").replace("x + dx AS x, y + dy AS y", "x + dx / 100 AS x, y + dy / 100 AS y").replace("SELECT s.c_custkey, s.x AS lon", "SELECT s.c_custkey, s.i, s.x AS lon")


@query(_PLOT_AREA + _forward("f", "z", "c_custkey, i, epsg") + f""", g AS (SELECT c_custkey, floor(min(px) / 10) * 10 AS l, floor(min(py) / 10) * 10 AS b, ceil(max(px) / 10) * 10 AS r, ceil(max(py) / 10) * 10 AS t FROM f GROUP BY 1),
k AS (SELECT a.c_custkey, a.px, a.py, b.px AS qx, b.py AS qy FROM f a JOIN f b ON a.c_custkey = b.c_custkey AND b.i = (a.i + 1) % {len(_CORNERS)}),
c AS (SELECT c_custkey, i.range AS row, j.range AS col, l + (j.range + 0.5) * 10 AS x, t - (i.range + 0.5) * 10 AS y FROM g, range(60) i, range(60) j WHERE i.range < (t - b) / 10 AND j.range < (r - l) / 10)
SELECT c.c_custkey, CAST(row AS INT) AS row, CAST(col AS INT) AS col, any_value(x) AS x, any_value(y) AS y, count(*) FILTER ((py > y) <> (qy > y) AND x < (qx - px) * (y - py) / nullif(qy - py, 0) + px) % 2 = 1 AS in_aoi FROM c JOIN k USING (c_custkey) GROUP BY 1, 2, 3""")
def grid_cells_function(spark, d):
    k = F.col("c_custkey")
    x, y = (k * 37 % 3500).cast("double") / 10 - 175, (k * 53 % 1200).cast("double") / 10 - 60
    ring = F.array(*[F.struct((x + a / 100).alias("x"), (y + b / 100).alias("y")) for a, b in _CORNERS])
    return grid_cells.cells(grid.canonical_grids(_t(spark, d, "customer").select("c_custkey", ring.alias("ring"))), "c_custkey")


assert len(_SHAPE) == 5  # the ring that _SIDES states
