"""Grids, whole acquisitions, processing, requests, formats, the store and the job queue over the driver tables, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from verdara.functions import formatting, projection
from verdara.functions.geo import E
from verdara.operators import acquisition, grid, process, requests, store
from verdara.plans.queries import _GRAN, _granules, _t, query
from verdara.plans.registry import QUERIES
from verdara.sources import catalog
from verdara.streaming import jobs

# -- grids: a ring of five corners for each customer ---------------------------------------------------
_CORNERS = ((0.0, 0.0), (0.08, 0.01), (0.1, 0.09), (0.05, 0.04), (0.01, 0.1))


def _areas(spark, d):
    k = F.col("c_custkey")
    x, y = (k * 37 % 3500).cast("double") / 10 - 179, (k * 53 % 1500).cast("double") / 10 - 75
    ring = F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in _CORNERS])
    return _t(spark, d, "customer").select("c_custkey", ring.alias("ring"))


def _forward(name: str, source: str, keep: str) -> str:
    """CTEs that project (lon, lat, zone) of `source` to `name` (keep, px, py)."""
    east = " ".join(f"+ {c!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(projection.SERIES, 1))
    north = " ".join(f"+ {c!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(projection.SERIES, 1))
    k = f"{projection.K0 * projection.RADIUS!r}::DOUBLE"
    return f""", {name}1 AS (SELECT *, radians(lon - ((epsg % 100) * 6 - 183)) AS turn, sinh(atanh(sin(radians(lat))) - {E!r}::DOUBLE * atanh({E!r}::DOUBLE * sin(radians(lat)))) AS t FROM {source}),
{name}2 AS (SELECT *, atan2(t, cos(turn)) AS xi, atanh(sin(turn) / sqrt(1 + t * t)) AS eta FROM {name}1),
{name} AS (SELECT {keep}, 500000 + {k} * (eta {east}) AS px, {k} * (xi {north}) + CASE WHEN epsg >= 32700 THEN 10000000 ELSE 0 END AS py FROM {name}2)"""


def _backward(name: str, source: str, keep: str) -> str:
    """CTEs that take (px, py, epsg) of `source` back to `name` (keep, lon, lat)."""
    k = f"{projection.K0 * projection.RADIUS!r}::DOUBLE"
    xi = " ".join(f"- {c!r}::DOUBLE * sin({2 * j} * up) * cosh({2 * j} * rt)" for j, c in enumerate(projection.INVERSE, 1))
    eta = " ".join(f"- {c!r}::DOUBLE * cos({2 * j} * up) * sinh({2 * j} * rt)" for j, c in enumerate(projection.INVERSE, 1))
    lat = " ".join(f"+ {c!r}::DOUBLE * sin({2 * j} * chi)" for j, c in enumerate(projection.LATITUDE, 1))
    return f""", {name}1 AS (SELECT *, (py - CASE WHEN epsg >= 32700 THEN 10000000 ELSE 0 END) / {k} AS up, (px - 500000) / {k} AS rt FROM {source}),
{name}2 AS (SELECT *, up {xi} AS xi, rt {eta} AS eta FROM {name}1), {name}3 AS (SELECT *, asin(sin(xi) / cosh(eta)) AS chi FROM {name}2),
{name} AS (SELECT {keep}, degrees(atan2(sinh(eta), cos(xi))) + ((epsg % 100) * 6 - 183) AS lon, degrees(chi {lat}) AS lat FROM {name}3)"""


_RING = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(_CORNERS))
_AREA = f"""WITH v(i, dx, dy) AS (VALUES {_RING}), o AS (SELECT c_custkey, CAST(c_custkey * 37 % 3500 AS DOUBLE) / 10 - 179 AS x, CAST(c_custkey * 53 % 1500 AS DOUBLE) / 10 - 75 AS y FROM customer),
s AS (SELECT c_custkey, i, x + dx AS x, y + dy AS y FROM o, v), e AS (SELECT a.c_custkey, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM s a JOIN s b ON a.c_custkey = b.c_custkey AND b.i = (a.i + 1) % {len(_CORNERS)}),
m AS (SELECT c_custkey, sum((px + qx) * (px * qy - qx * py)) / (3 * sum(px * qy - qx * py)) AS cx, sum((py + qy) * (px * qy - qx * py)) / (3 * sum(px * qy - qx * py)) AS cy FROM e GROUP BY 1),
z AS (SELECT s.c_custkey, s.x AS lon, s.y AS lat, CAST(CASE WHEN cy >= 0 THEN 32600 ELSE 32700 END + CAST(floor((cx + 180) / 6) AS BIGINT) % 60 + 1 AS INT) AS epsg FROM s JOIN m USING (c_custkey))"""
_GRID = (
    _AREA
    + _forward("f", "z", "c_custkey, epsg")
    + ", g AS (SELECT c_custkey, epsg, floor(min(px) / 10) * 10 AS l, floor(min(py) / 10) * 10 AS b, ceil(max(px) / 10) * 10 AS r, ceil(max(py) / 10) * 10 AS t FROM f GROUP BY 1, 2), k AS (SELECT c_custkey, epsg, unnest([l, l, r, r]) AS px, unnest([b, t, b, t]) AS py FROM g)"
    + _backward("w", "k", "c_custkey")
    + ", n AS (SELECT c_custkey, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM w GROUP BY 1)"
)


@query(_GRID + """ SELECT g.c_custkey, epsg, CAST(round((r - l) / 10) AS INT) AS width, CAST(round((t - b) / 10) AS INT) AS height, l AS "left", t AS top, round(west, 7) AS west, round(south, 7) AS south, round(east, 7) AS east, round(north, 7) AS north,
'EPSG:' || epsg || ':' || CAST(round((r - l) / 10) AS INT) || 'x' || CAST(round((t - b) / 10) AS INT) || ':' || printf('%.6g,%.6g,%.6g,%.6g,%.6g,%.6g', 10.0::DOUBLE, 0.0::DOUBLE, l, 0.0::DOUBLE, -10.0::DOUBLE, t) AS signature FROM g JOIN n USING (c_custkey)""")
def canonical_grid(spark, d):
    g = grid.canonical_grids(_areas(spark, d))
    bounds = [F.round(F.col("bounds_geographic")[k], 7).alias(n) for k, n in enumerate(("west", "south", "east", "north"))]
    return g.select("c_custkey", "epsg", "width", "height", "left", "top", *bounds, "signature")


@query("""WITH k AS (SELECT c_custkey, 32600 + c_custkey % 60 + 1 + CASE WHEN c_custkey % 2 = 0 THEN 100 ELSE 0 END AS epsg, 200000.0::DOUBLE + c_custkey * 7919 % 600000 AS px, CASE WHEN c_custkey % 2 = 0 THEN 2000000.0::DOUBLE ELSE 100000.0::DOUBLE END + c_custkey * 104729 % 7000000 AS py FROM customer)""" + _backward("w", "k", "c_custkey") + " SELECT c_custkey, round(lon, 7) AS lon, round(lat, 7) AS lat FROM w")
def utm_unproject(spark, d):
    k = F.col("c_custkey")
    south = k % 2 == 0
    epsg = 32600 + k % 60 + 1 + F.when(south, 100).otherwise(0)
    lon, lat = projection.lonlat(200000.0 + k * 7919 % 600000, F.when(south, 2000000.0).otherwise(100000.0) + k * 104729 % 7000000, epsg)
    return _t(spark, d, "customer").select("c_custkey", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


# -- whole acquisitions --------------------------------------------------------------------------------
_WHOLE = """WITH g0 AS (SELECT event_id, ts, event_type AS platform, user_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS cloud, least(value, 100) AS overlap, strftime(ts, '%Y%m%dT%H%M%S') AS stamp,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '05.00' ELSE '03.01' END AS baseline FROM events),
g AS (SELECT *, 'S2A_MSIL2A_' || strftime(date_trunc('day', ts), '%Y%m%dT%H%M%S') || '_R00' || (user_id % 3) || '_T17TL' || chr(CAST(71 + user_id % 4 AS INT)) || '_' || stamp AS item_id,
  's2|' || lower(platform) || '|R00' || (user_id % 3) || '|' || strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S+00:00') AS key FROM g0)"""


def _whole_granules(spark, d):
    e = _t(spark, d, "events")
    day, u = F.date_trunc("day", "ts"), F.col("user_id")
    form = "yyyyMMdd'T'HHmmss"
    item = F.concat(F.lit("S2A_MSIL2A_"), F.date_format(day, form), F.lit("_R00"), (u % 3).cast("string"), F.lit("_T17TL"), F.char((F.lit(71) + u % 4).cast("long")), F.lit("_"), F.date_format("ts", form))
    k = F.col("event_id") % 4
    baseline = F.when(k == 1, "").when(k == 2, "05.00").when(k == 3, "03.01")
    return e.select(
        item.alias("item_id"), F.lit("s2").alias("collection"), day.alias("observed_at"), F.get_json_object("props", "$.k").cast("double").alias("cloud_cover_pct"), F.col("event_type").alias("platform"), baseline.alias("processing_baseline"),
        F.create_map(F.lit("red"), F.concat(F.lit("r"), F.col("event_id").cast("string"))).alias("assets"), F.least("value", F.lit(100.0)).alias("aoi_overlap_pct"), F.lit(None).cast("array<array<struct<x:double,y:double>>>").alias("footprint"),
    )


@query(_WHOLE + """ SELECT key AS acquisition_key, count(*) AS granule_count, max_by(item_id, (overlap, item_id)) AS primary_item_id, min_by(regexp_extract(item_id, '_(R\\d{3})_', 1), item_id) AS relative_orbit, string_agg(DISTINCT regexp_extract(item_id, '_(T\\d\\d[A-Z]{3})_', 1), ' ' ORDER BY regexp_extract(item_id, '_(T\\d\\d[A-Z]{3})_', 1)) AS tile_ids,
 coalesce(string_agg(DISTINCT baseline, ' ' ORDER BY baseline) FILTER (baseline <> ''), '') AS baselines, min(baseline) FILTER (baseline <> '') AS dominant_baseline, count(DISTINCT baseline) FILTER (baseline <> '') > 1 AS mixed,
 round(sum(cloud * greatest(overlap, 1e-6)) / sum(CASE WHEN cloud IS NOT NULL THEN greatest(overlap, 1e-6) END), 6) AS cloud FROM g GROUP BY 1""")
def acquisition_record(spark, d):
    r = acquisition.acquisition_records(_whole_granules(spark, d))
    words = lambda c: F.array_join(c, " ")
    return r.select("acquisition_key", F.col("granule_count").cast("long").alias("granule_count"), "primary_item_id", "relative_orbit", words("tile_ids").alias("tile_ids"), words("processing_baselines").alias("baselines"), "dominant_baseline", (F.size("processing_baselines") > 1).alias("mixed"), F.round("cloud_cover_pct", 6).alias("cloud"))


# -- processing: two granules an acquisition, each a pair of 8 x 8 tiles -------------------------------
_STEPS = """WITH v AS (SELECT vec_id, vec_id // 2 AS acquisition, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
g AS (SELECT a.acquisition, a.vec_id AS item_id, a.pos // 8 AS row, a.pos % 8 AS col, CASE WHEN (a.vec_id + a.pos) % 31 <> 0 THEN floor((CAST(a.v AS DOUBLE) + 1) * 5000) END AS red, floor((CAST(b.v AS DOUBLE) + 1) * 5000) AS nir, CAST((a.vec_id * 7 + a.pos * 5) % 12 AS DOUBLE) AS scl,
  CASE WHEN a.vec_id % 10 = 4 THEN false WHEN a.vec_id % 2 = 0 THEN a.pos % 8 <= 5 ELSE a.pos % 8 >= 3 END AS covered FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.pos = 63 - a.pos),
c AS (SELECT * REPLACE (CASE WHEN covered THEN red END AS red, CASE WHEN covered THEN nir END AS nir, CASE WHEN covered THEN scl END AS scl) FROM g),
w AS (SELECT acquisition, row, col, arg_min(red, item_id) FILTER (red IS NOT NULL) AS red_dn, arg_min(nir, item_id) FILTER (nir IS NOT NULL) AS nir_dn, arg_min(scl, item_id) FILTER (scl IS NOT NULL) AS scl, bool_or(covered) AS covered,
  min(item_id) FILTER (red IS NOT NULL) AS i1, min(item_id) FILTER (nir IS NOT NULL) AS i2 FROM c GROUP BY 1, 2, 3),
s AS (SELECT *, row BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6 AS in_aoi, CASE WHEN acquisition % 3 = 1 THEN 0.0 ELSE -0.1 END::DOUBLE AS off FROM w),
r AS (SELECT *, red_dn * 1e-4 + off AS red, nir_dn * 1e-4 + off AS nir, scl IS NOT NULL AND scl NOT IN (0, 1, 3, 8, 9, 10, 11) AS ok FROM s),
x AS (SELECT *, CASE WHEN red < 0 THEN 0 ELSE red END AS r0, CASE WHEN nir < 0 THEN 0 ELSE nir END AS n0 FROM r),
y AS (SELECT *, CASE WHEN ok AND in_aoi THEN CAST((n0 - r0) / nullif(n0 + r0, 0) AS FLOAT) END AS ndvi FROM x),
z AS (SELECT *, CASE WHEN NOT covered THEN 'uncovered' WHEN scl IS NULL OR scl = 0 OR red IS NULL OR nir IS NULL THEN 'nodata' WHEN scl IN (3, 8, 9, 10) THEN 'cloud' WHEN scl = 11 THEN 'snow' WHEN scl = 1 THEN 'other_masked' WHEN ndvi IS NULL THEN 'invalid_spectral' ELSE 'valid' END AS class FROM y),
a AS (SELECT acquisition, count(*) FILTER (in_aoi) AS aoi_px, count(*) FILTER (in_aoi AND covered) AS covered_px, count(ndvi) AS valid_px, round(avg(CAST(ndvi AS DOUBLE)), 6) AS ndvi_mean, round(quantile_cont(CAST(ndvi AS DOUBLE), 0.5), 6) AS ndvi_median,
  count(*) FILTER (in_aoi AND class IN ('uncovered', 'nodata')) AS missing_px, count(*) FILTER (in_aoi AND class = 'cloud') AS cloud_px FROM z GROUP BY 1),
u AS (SELECT acquisition, string_agg(DISTINCT i, ' ' ORDER BY i) AS used FROM (SELECT acquisition, unnest([i1, i2]) AS i FROM w) WHERE i IS NOT NULL GROUP BY 1),
t AS (SELECT *, CASE WHEN covered_px = 0 THEN 'no_raster_overlap_with_aoi' WHEN 100.0 * covered_px / aoi_px < 99 THEN 'insufficient_aoi_coverage' WHEN valid_px = 0 THEN 'all_pixels_masked' WHEN round(100.0 * valid_px / aoi_px, 4) < 10 THEN 'insufficient_valid_pixels' END AS reason FROM a)"""


def _processed(spark, d):
    v = _t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"), "embedding")
    k, p = F.col("vec_id"), F.col("pos")
    dn = lambda x: F.floor((x.cast("double") + 1) * 5000).cast("double")
    red = F.when((k + p) % 31 != 0, dn(F.col("v")))
    values = {"red": red, "nir": dn(F.element_at("embedding", F.lit(64) - p)), "scl": ((k * 7 + p * 5) % 12).cast("double")}
    col = p % 8
    covered = F.when(k % 10 == 4, False).when(k % 2 == 0, col <= 5).otherwise(col >= 3)
    rows = v.select(F.floor(k / 2).alias("acquisition"), k.alias("item_id"), F.floor(p / 8).cast("int").alias("row"), col.cast("int").alias("col"), covered.alias("covered"), F.explode(F.create_map(*[x for b, c in values.items() for x in (F.lit(b), c)])).alias("band", "value"))
    granules = rows.withColumn("value", F.when(F.col("covered"), F.col("value")))
    key = F.col("acquisition")
    acqs = granules.groupBy("acquisition").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")).select("acquisition", F.when(key % 3 == 1, "03.01").when(key % 3 == 2, "05.00").alias("dominant_baseline"), "item_ids")
    cells = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col")).withColumn("in_aoi", F.col("row").between(1, 6) & F.col("col").between(1, 6))
    return process.process_acquisitions(acqs, granules, F.broadcast(cells))  # 64 cells


@query(_STEPS + """ SELECT t.acquisition, reason IS NULL AS usable, reason, CASE WHEN acquisition % 3 = 1 THEN 0.0 ELSE -0.1 END::DOUBLE AS "offset", CASE WHEN covered_px > 0 THEN aoi_px END AS aoi_px, CASE WHEN covered_px > 0 THEN covered_px END AS covered_px, CASE WHEN covered_px > 0 THEN valid_px END AS valid_px,
CASE WHEN covered_px > 0 THEN ndvi_mean END AS ndvi_mean, CASE WHEN covered_px > 0 THEN ndvi_median END AS ndvi_median, CASE WHEN covered_px > 0 THEN round(100.0 * missing_px / aoi_px, 4) END AS missing_data_pct, CASE WHEN covered_px > 0 THEN cloud_px END AS cloud_px,
coalesce(used, (2 * acquisition) || ' ' || (2 * acquisition + 1)) AS contributors FROM t LEFT JOIN u USING (acquisition)""")
def process_acquisition(spark, d):
    r = _processed(spark, d)
    return r.select("acquisition", "usable", "reason", F.col("scaling.offset").alias("offset"), "aoi_px", "covered_px", "valid_px", "ndvi_mean", "ndvi_median", "missing_data_pct", "cloud_px", F.concat_ws(" ", F.transform("contributing_item_ids", lambda i: i.cast("string"))).alias("contributors"))


# -- search metadata, requests, formats ----------------------------------------------------------------
@query(_GRAN + """, w(window_id, ws, we) AS (VALUES (0, DATE '2024-01-01', DATE '2024-01-08'), (1, DATE '2024-01-09', DATE '2024-01-16'), (2, DATE '2024-01-17', DATE '2024-01-24'), (3, DATE '2024-01-25', DATE '2024-01-30')),
h AS (SELECT window_id, count(*) AS n FROM g JOIN w ON CAST(ts AS DATE) BETWEEN ws AND we WHERE cloud < 30 GROUP BY 1)
SELECT count(*) AS window_count, string_agg(ws || '/' || we, ' ' ORDER BY ws) AS windows, coalesce(string_agg(ws || '/' || we, ' ' ORDER BY ws) FILTER (n >= 150), '') AS truncated_windows, CAST(sum(least(coalesce(n, 0), 150)) AS BIGINT) AS granules_returned, 150 AS max_items_per_window FROM w LEFT JOIN h USING (window_id)""")
def search_metadata(spark, d):
    wins = catalog.windows(spark, date(2024, 1, 1), date(2024, 1, 30), 8)
    m = catalog.search_metadata(catalog.search(_granules(spark, d), wins, 30.0, 150), wins, 150)
    return m.select("window_count", *[F.array_join(c, " ").alias(c) for c in ("windows", "truncated_windows")], "granules_returned", "max_items_per_window")


_L = requests.Limits()


def _requests(spark, d):
    k, c = F.col("o_orderkey"), F.col
    day = F.to_date("o_orderdate")
    side = (k % 40 + 1).cast("double") * 0.01
    box = F.when(k % 9 != 0, F.array(F.lit(10.0), F.lit(0.0), 10.0 + side, F.when(k % 11 == 0, -1.0).otherwise(0.2)))
    shifted = F.date_add(day, F.lit(7300))
    return _t(spark, d, "orders").select(
        "o_orderkey", F.when(k % 2 == 0, k).alias("region_id"), box.alias("bbox"), shifted.alias("start_date"), F.date_add(shifted, ((c("o_custkey") % 5000) - 500).cast("int")).alias("end_date"),
        (k % 101).cast("double").alias("max_cloud_cover_pct"), F.when(k % 3 != 0, (k % 16).cast("int")).alias("scene_limit"), F.when(k % 7 == 0, "yearly").otherwise("seasonal").alias("strategy"), (k % 14).cast("int").alias("target_month"),
    )


def _area_of_box(w: str, s: str, e: str, n: str) -> str:
    from verdara.plans.queries import _area_sql

    return _area_sql(w, s, e, n)


@query(f"""WITH r AS (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 2 = 1 AS custom, o_orderkey % 9 <> 0 AS boxed, 10.0::DOUBLE AS w, 0.0::DOUBLE AS s, 10.0::DOUBLE + (o_orderkey % 40 + 1) * 0.01::DOUBLE AS e, CASE WHEN o_orderkey % 11 = 0 THEN -1.0 ELSE 0.2 END::DOUBLE AS n,
  CAST(o_orderdate AS DATE) + 7300 AS a, CAST(o_orderdate AS DATE) + 7300 + CAST(o_custkey % 5000 - 500 AS INT) AS b, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 16 ELSE {_L.default_scenes} END AS scenes FROM orders),
q AS (SELECT *, CASE WHEN boxed AND n > s THEN {_area_of_box('w', 's', 'e', 'n')} END AS area FROM r)
SELECT o_orderkey, round(area, 4) AS area_km2, concat_ws(',', CASE WHEN custom AND NOT boxed THEN 'no_area' END, CASE WHEN boxed AND n <= s THEN 'bbox_south_not_below_north' END,
CASE WHEN area > CASE WHEN custom THEN {_L.max_custom_area_km2} ELSE {_L.max_area_km2} END THEN 'area_above_maximum' END, CASE WHEN area < {_L.min_area_km2} THEN 'area_below_minimum' END, CASE WHEN b < a THEN 'end_before_start' END,
CASE WHEN a < DATE '{_L.min_start}' THEN 'start_before_archive' END, CASE WHEN a > DATE '2018-01-01' THEN 'start_in_future' END, CASE WHEN date_diff('day', a, b) > {_L.max_span_days} THEN 'span_too_long' END,
CASE WHEN scenes < 1 OR scenes > {_L.max_scenes} THEN 'scene_limit' END, CASE WHEN k % 101 > {_L.max_cloud_pct} THEN 'cloud_limit' END, CASE WHEN k % 7 = 0 THEN 'strategy' END, CASE WHEN k % 14 NOT BETWEEN 1 AND 12 THEN 'target_month' END) AS problems FROM q""")
def request_violations(spark, d):
    r = requests.violations(_requests(spark, d), _L, date(2018, 1, 1))
    return r.select("o_orderkey", F.round("area_km2", 4).alias("area_km2"), F.array_join("problems", ",").alias("problems"))


@query(f"""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN strftime(o_orderdate + INTERVAL 7300 DAY, '%d.%m.%Y') ELSE strftime(o_orderdate + INTERVAL 7300 DAY, '%Y-%m-%d') END AS s, strftime(o_orderdate + INTERVAL 7300 DAY + INTERVAL (CAST(o_custkey % 5000 - 500 AS INT)) DAY, '%Y-%m-%d') AS e FROM orders),
d AS (SELECT *, CASE WHEN regexp_matches(s, '^[0-9]{{4}}-') THEN CAST(s AS DATE) END AS a, CAST(e AS DATE) AS b FROM r)
SELECT o_orderkey, CASE WHEN s = '' THEN 'Choose both a start and an end date.' WHEN a IS NULL THEN 'Dates must use the YYYY-MM-DD format.' WHEN a > b THEN 'The start date must be on or before the end date.' WHEN a < DATE '{_L.min_start}' THEN 'The start date cannot be before {_L.min_start} (earliest supported observation).'
WHEN b > DATE '2024-06-01' THEN 'The end date cannot be in the future.' WHEN date_diff('day', a, b) > {_L.max_span_days} THEN 'The date range spans ' || format('{{:,}}', date_diff('day', a, b)) || ' days, which exceeds the {_L.max_span_days:,}-day limit.' END AS message FROM d""")
def date_messages(spark, d):
    k, at = F.col("o_orderkey"), F.date_add(F.to_date("o_orderdate"), F.lit(7300))
    iso = F.date_format(at, "yyyy-MM-dd")
    start = F.when(k % 5 == 0, "").when(k % 5 == 1, F.date_format(at, "dd.MM.yyyy")).otherwise(iso)
    end = F.date_format(F.date_add(at, ((F.col("o_custkey") % 5000) - 500).cast("int")), "yyyy-MM-dd")
    return _t(spark, d, "orders").select("o_orderkey", requests.date_range_message(start, end, _L, date(2024, 6, 1)).alias("message"))


_TRIM = "regexp_replace(regexp_replace({0}, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


@query(f"""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey * 1.25::DOUBLE END AS v, CAST(p_partkey AS BIGINT) * p_partkey * 331 AS n, p_partkey * 3 AS d, p_name FROM part)
SELECT k AS p_partkey, CASE WHEN v IS NULL THEN '—' ELSE replace(printf('%.3f', 100 - v), '-', '−') END AS number, CASE WHEN v IS NULL THEN '—' ELSE CASE WHEN v > 100 THEN '+' WHEN v < 100 THEN '−' ELSE '±' END || printf('%.3f', abs(v - 100)) END AS change, CASE WHEN v IS NULL THEN '—' ELSE printf('%.1f', v * 2) || '%' END AS percent,
CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN CASE WHEN n / 1024.0::DOUBLE >= 10 THEN CAST(floor(n / 1024.0::DOUBLE + 0.5) AS BIGINT) || '' ELSE printf('%.1f', n / 1024.0::DOUBLE) END || ' KB' WHEN n < 1073741824 THEN CASE WHEN n / 1048576.0::DOUBLE >= 10 THEN CAST(floor(n / 1048576.0::DOUBLE + 0.5) AS BIGINT) || '' ELSE printf('%.1f', n / 1048576.0::DOUBLE) END || ' MB'
  WHEN n < 1099511627776 THEN CASE WHEN n / 1073741824.0::DOUBLE >= 10 THEN CAST(floor(n / 1073741824.0::DOUBLE + 0.5) AS BIGINT) || '' ELSE printf('%.1f', n / 1073741824.0::DOUBLE) END || ' GB'
  ELSE CASE WHEN n / 1099511627776.0::DOUBLE >= 10 THEN CAST(floor(n / 1099511627776.0::DOUBLE + 0.5) AS BIGINT) || '' ELSE printf('%.1f', n / 1099511627776.0::DOUBLE) END || ' TB' END AS size,
CASE WHEN v IS NULL THEN '—' WHEN v >= 100 THEN format('{{:,}}', CAST(floor(v + 0.5) AS BIGINT)) || ' km²' WHEN v >= 10 THEN {_TRIM.format("printf('%.2f', round(v, 1))")} || ' km²' ELSE printf('%.2f', v) || ' km²' END AS km2,
format('{{:,}}', d) || ' days' || CASE WHEN d < 730 THEN '' ELSE ' (about ' || {_TRIM.format("format('{:,.2f}', round(d / 365.25::DOUBLE, 1))")} || ' years)' END AS span,
CASE WHEN length(p_name) <= 12 THEN p_name ELSE left(p_name, 5) || '…' || right(p_name, 5) END AS name FROM p""")
def formats(spark, d):
    k = F.col("p_partkey")
    v, n = F.when(k % 13 != 0, k * 1.25), k.cast("long") * k * 331
    f = formatting
    return _t(spark, d, "part").select("p_partkey", f.number(100 - v).alias("number"), f.change(v - 100).alias("change"), f.percent(v * 2).alias("percent"), f.size(n).alias("size"), f.km2(v).alias("km2"), f.day_span(k * 3).alias("span"), f.truncate_middle(F.col("p_name"), 12).alias("name"))


@query(f"""WITH a AS (SELECT c_custkey AS k, c_custkey * 0.3::DOUBLE AS v, c_custkey % 2 = 1 AS custom FROM customer), t AS (SELECT *, CASE WHEN v >= 100 THEN format('{{:,}}', CAST(floor(v + 0.5) AS BIGINT)) WHEN v >= 10 THEN {_TRIM.format("printf('%.2f', round(v, 1))")} ELSE printf('%.2f', v) END || ' km²' AS s FROM a)
SELECT k AS c_custkey, CASE WHEN v > CASE WHEN custom THEN 250 ELSE 600 END THEN CASE WHEN custom THEN 'Drawn area of ' || s || ' exceeds the maximum of 250 km² for custom areas. Draw a smaller box, or choose a predefined region to analyse a larger area.' ELSE 'This region covers ' || s || ', above the 600 km² limit for predefined regions.' END
WHEN v < 0.5 THEN CASE WHEN custom THEN 'Drawn' ELSE 'Region' END || ' area of ' || s || ' is below the 0.5 km² minimum. ' || CASE WHEN custom THEN 'Draw a larger box.' ELSE 'Choose another region.' END END AS message FROM t""")
def area_messages(spark, d):
    k = F.col("c_custkey")
    return _t(spark, d, "customer").select("c_custkey", requests.area_message(k * 0.3, k % 2 == 1, _L).alias("message"))


# -- the store -----------------------------------------------------------------------------------------
@query("SELECT l_partkey % 50 AS item, l_returnflag AS kind, min_by(l_orderkey * 10 + l_linenumber, (l_shipdate, l_orderkey, l_linenumber)) AS first FROM lineitem GROUP BY 1, 2")
def artifact_lookup(spark, d):
    line = _t(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("item"), F.col("l_returnflag").alias("kind"), "l_orderkey", "l_linenumber", "l_shipdate")
    found = store.first_artifacts(line, ["item", "kind"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    return found.select("item", "kind", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))


@query("""WITH a AS (SELECT o_custkey AS analysis, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 4 = 0 THEN 'scene' || o_orderkey % 3 WHEN o_orderkey % 4 = 1 THEN 'item' || o_orderkey % 5 ELSE 'unattributed' END AS item, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders)
SELECT analysis, item, count(*) AS n_files, round(sum(size) / 1e6, 6) AS size_mb FROM a GROUP BY 1, 2""")
def artifact_groups(spark, d):
    k = F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "P", "provenance").otherwise("ndvi_cog")
    item, scene = F.when(k % 4 == 1, F.concat(F.lit("item"), (k % 5).cast("string"))), F.when(k % 4 == 0, F.concat(F.lit("scene"), (k % 3).cast("string")))
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("analysis_id"), kind.alias("artifact_type"), item.alias("item_id"), scene.alias("scene_id"), k.cast("string").alias("path"), F.floor("o_totalprice").alias("size_bytes"))
    return store.grouped_artifacts(rows).select(F.col("analysis_id").alias("analysis"), "item", "n_files", F.round("size_mb", 6).alias("size_mb"))


@query("SELECT user_id, arg_max(event_id, (k, -event_id)) AS cloudiest, arg_min(event_id, (k, event_id)) AS clearest FROM (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def cloud_extremes(spark, d):
    rows = _t(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return store.extremes_by_cloud(rows, "user_id", "k", "event_id")


@query("""WITH v AS (SELECT label, vec_id, list_min(embedding[1:3])::DOUBLE AS lo, list_max(embedding[1:3])::DOUBLE AS hi FROM embeddings)
SELECT label, greatest(floor((min(lo) - 0.05::DOUBLE) * 10) / 10, -1) AS low, least(ceil((max(hi) + 0.05::DOUBLE) * 10) / 10, 1) AS high FROM v GROUP BY 1""")
def axis_domain(spark, d):
    e = _t(spark, d, "embeddings").select("label", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(("mean", "p25", "p75"))])
    return store.axis_domain(e, "label", ["mean", "p25", "p75"])


@query("""WITH r AS (SELECT o_custkey AS analysis, o_orderdate AS seen, o_orderkey AS key, o_orderkey % 3 <> 0 AS ok, CASE WHEN o_orderkey % 10 <> 0 THEN round(o_totalprice / 500000, 3) END AS mean, (o_orderkey % 100)::DOUBLE AS pct, 'g' || CASE WHEN o_custkey % 4 = 0 THEN o_orderkey % 2 ELSE 0 END AS grid FROM orders),
x AS (SELECT *, row_number() OVER (PARTITION BY analysis, ok ORDER BY seen, key) AS f, row_number() OVER (PARTITION BY analysis, ok ORDER BY seen DESC, key DESC) AS l FROM r)
SELECT analysis, count(*) FILTER (ok) AS usable, count(*) FILTER (NOT ok) AS unusable, round(max(mean) FILTER (ok AND l = 1) - max(mean) FILTER (ok AND f = 1), 6) AS change, round(avg(pct) FILTER (ok), 6) AS mean_pct, CASE WHEN count(*) FILTER (ok) > 0 THEN count(DISTINCT grid) FILTER (ok) <= 1 END AS one_grid FROM x GROUP BY 1""")
def analysis_summaries(spark, d):
    k = F.col("o_orderkey")
    grids = F.concat(F.lit("g"), F.when(F.col("o_custkey") % 4 == 0, (k % 2).cast("string")).otherwise("0"))
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("analysis_id"), F.col("o_orderdate").alias("observed_at"), k.alias("acquisition_key"), (k % 3 != 0).alias("usable"), F.when(k % 10 != 0, F.round(F.col("o_totalprice") / 500000, 3)).alias("ndvi_mean"), (k % 100).cast("double").alias("valid_pixel_pct"), F.lit(100.0).alias("coverage_pct"), grids.alias("grid"))
    s = store.analysis_summary(rows)
    return s.select(F.col("analysis_id").alias("analysis"), F.col("usable_scene_count").alias("usable"), F.col("unusable_scene_count").alias("unusable"), F.round("ndvi_mean_change", 6).alias("change"), F.round("mean_valid_pixel_pct", 6).alias("mean_pct"), F.col("identical_analytical_grid").alias("one_grid"))


def _analyses(spark, d):
    c = F.col("c_custkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ("succeeded", "failed", "queued", "running")]), (c % 4 + 1).cast("int"))
    version = F.concat((c % 3 + 1).cast("string"), F.lit(".0.0"))
    return _t(spark, d, "customer").select(c.alias("id"), status.alias("status"), version.alias("processing_version"), (c % 20 == 0).alias("is_demo"), c.alias("submitted_at"))


@query("""WITH a AS (SELECT c_custkey AS id, ['succeeded', 'failed', 'queued', 'running'][c_custkey % 4 + 1] AS status, c_custkey % 3 + 1 AS major, c_custkey % 20 = 0 AS demo FROM customer), n AS (SELECT max(id) AS newest FROM a WHERE demo AND status = 'succeeded'),
s AS (SELECT o_custkey AS id, count(*) AS n, sum(CAST(o_orderkey AS BIGINT)) AS b FROM orders GROUP BY 1)
SELECT a.id, coalesce(n, 0) AS n_artifacts, round(coalesce(b, 0) / 1e6, 6) AS size_mb, CASE WHEN status IN ('queued', 'running') THEN 'in_flight' WHEN a.id = newest THEN 'demo' END AS refused FROM a CROSS JOIN n LEFT JOIN s USING (id) WHERE major < 2""".replace("coalesce(n, 0)", "coalesce(s.n, 0)"))
def deletion_plan(spark, d):
    files = _t(spark, d, "orders").select(F.col("o_custkey").alias("analysis_id"), F.col("o_orderkey").cast("long").alias("size_bytes"))
    return store.deletion_plan(_analyses(spark, d), files, legacy=True).withColumn("size_mb", F.round("size_mb", 6))


@query("SELECT c_custkey AS id, '/api/v1/analyses/' || c_custkey || '/scenes' AS scenes, round(c_acctbal, 2) AS area_km2, n_name AS region, CASE WHEN c_custkey % 4 = 1 THEN 'data:' || c_name END AS failure FROM customer JOIN nation ON c_nationkey = n_nationkey")
def analysis_records(spark, d):
    c = F.col("c_custkey")
    rows = _t(spark, d, "customer").select(c.alias("id"), F.col("c_nationkey").alias("region_id"), F.col("c_acctbal").alias("area_km2"), F.when(c % 4 == 1, "data").alias("failure_category"), F.col("c_name").alias("failure_detail"))
    regions = _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    r = store.records(rows, regions)
    return r.select("id", F.col("links.scenes").alias("scenes"), "area_km2", F.col("region.name").alias("region"), F.concat(F.col("failure.category"), F.lit(":"), F.col("failure.detail")).alias("failure"))


# -- the job queue -------------------------------------------------------------------------------------
@query("SELECT event_id, (event_id % 17 = 0) OR (event_id % 6 > 3) AS poison, greatest(CAST(event_id % 50 AS DOUBLE) - 5, 0) AS delay_s FROM events")
def message_deliveries(spark, d):
    k, at = F.col("event_id"), F.col("ts").cast("timestamp")
    rows = _t(spark, d, "events").select("event_id", F.when(k % 17 != 0, k.cast("string")).otherwise("").alias("analysis_id"), (k % 6).alias("dequeue_count"), at.alias("enqueued_at"), F.timestamp_micros(F.unix_micros(at) + (k % 50 - 5) * 1_000_000).alias("received_at"))
    return jobs.delivered(rows).select("event_id", "poison", "delay_s")


@query("""WITH j AS (SELECT event_id, event_type AS s, ts, event_id % 5 AS retries FROM events), r AS (SELECT *, CASE s WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status FROM j),
f AS (SELECT *, CASE WHEN status = 'running' AND NOT ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 2 HOUR THEN 'running' WHEN status = 'succeeded' THEN 'succeeded' END AS refused FROM r)
SELECT event_id, refused, CASE WHEN refused IS NULL THEN 'queued' ELSE status END AS status, CASE WHEN refused IS NULL THEN retries + 1 ELSE retries END AS retry_count FROM f""")
def requeue(spark, d):
    kind = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "purchase", "succeeded").otherwise("failed")
    rows = _t(spark, d, "events").select("event_id", kind.alias("status"), F.col("ts").alias("started_at"), F.lit("x").alias("failure_category"), (F.col("event_id") % 5).alias("retry_count"))
    return jobs.requeued(rows, F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id", "refused", "status", "retry_count")


def rate_limit_exact(spark, d):
    """Accepted events of each client: what is refused doesn't count. Sequential, so the tests hold it against a plain walk."""
    rows = _t(spark, d, "events").select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("id"))
    return jobs.rate_limited_batch(rows, 2, 86_400).select(F.col("id").alias("event_id"), "accepted")


QUERIES["rate_limit_exact"] = rate_limit_exact
