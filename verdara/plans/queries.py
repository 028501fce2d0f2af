"""The engine's operators applied to the driver tables, each with the SQL that states its result."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdara.functions import geo
from verdara.operators import acquisition, raster, selection, store
from verdara.plans.registry import QUERIES, SQL
from verdara.sources import catalog, stac_items
from verdara.streaming import jobs


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- pixels: an 8 x 8 tile from each pair of vectors ---------------------------------------------------
PIX = """
WITH rd AS (SELECT vec_id // 2 AS acquisition, vec_id AS red_id, unnest(embedding) AS r, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings WHERE vec_id % 2 = 0),
nr AS (SELECT vec_id // 2 AS acquisition, unnest(embedding) AS n, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings WHERE vec_id % 2 = 1),
px AS (SELECT acquisition, pos, pos // 8 AS row, pos % 8 AS col,
  CASE WHEN (acquisition + pos) % 31 = 0 THEN NULL WHEN (acquisition + pos) % 37 = 0 THEN 1000 ELSE CAST(floor((CAST(r AS DOUBLE) + 1) * 5000) AS INT) END AS red_dn,
  CASE WHEN (acquisition + pos) % 37 = 0 THEN 1000 ELSE CAST(floor((CAST(n AS DOUBLE) + 1) * 5000) AS INT) END AS nir_dn,
  (red_id * 7 + pos * 5) % 12 AS scl, (acquisition + pos) % 29 <> 0 AS covered,
  pos // 8 BETWEEN 1 AND 6 AND pos % 8 BETWEEN 1 AND 6 AS in_aoi FROM rd JOIN nr USING (acquisition, pos)),
rf AS (SELECT *, CAST(red_dn AS DOUBLE) * 1e-4 + CAST(-0.1 AS DOUBLE) AS red, CAST(nir_dn AS DOUBLE) * 1e-4 + CAST(-0.1 AS DOUBLE) AS nir, scl NOT IN (0, 1, 3, 8, 9, 10, 11) AS ok FROM px),
cl AS (SELECT *, CASE WHEN red < 0 THEN 0 ELSE red END AS r0, CASE WHEN nir < 0 THEN 0 ELSE nir END AS n0 FROM rf),
nd AS (SELECT *, CASE WHEN ok THEN CAST((n0 - r0) / nullif(n0 + r0, 0) AS FLOAT) END AS ndvi, ok AND coalesce(n0 + r0 = 0, false) AS zero_den FROM cl),
ix AS (SELECT *, CASE WHEN NOT covered THEN 'uncovered' WHEN scl = 0 OR red IS NULL OR nir IS NULL THEN 'nodata' WHEN scl IN (3, 8, 9, 10) THEN 'cloud' WHEN scl = 11 THEN 'snow'
  WHEN scl = 1 THEN 'other_masked' WHEN ndvi IS NULL THEN 'invalid_spectral' ELSE 'valid' END AS class FROM nd),
st AS (SELECT acquisition, count(*) FILTER (in_aoi) AS aoi_px, count(v) AS valid_px, round(min(v), 6) AS ndvi_min, round(max(v), 6) AS ndvi_max, round(avg(v), 6) AS ndvi_mean,
  round(quantile_cont(v, 0.5), 6) AS ndvi_median, round(stddev_pop(v), 6) AS ndvi_std, round(quantile_cont(v, 0.1), 6) AS ndvi_p10, round(quantile_cont(v, 0.25), 6) AS ndvi_p25,
  round(quantile_cont(v, 0.75), 6) AS ndvi_p75, round(quantile_cont(v, 0.9), 6) AS ndvi_p90, count(*) FILTER (in_aoi) - count(v) AS masked_px,
  round(100.0 * count(v) / count(*) FILTER (in_aoi), 4) AS valid_pixel_pct FROM (SELECT *, CASE WHEN in_aoi THEN CAST(ndvi AS DOUBLE) END AS v FROM ix) GROUP BY 1),
cv AS (SELECT acquisition, count(*) FILTER (in_aoi) AS aoi_px, count(*) FILTER (in_aoi AND covered) AS covered_px, count(*) FILTER (in_aoi AND class = 'uncovered') AS uncovered_px,
  count(*) FILTER (in_aoi AND class = 'nodata') AS nodata_px, count(*) FILTER (in_aoi AND class = 'cloud') AS cloud_px, count(*) FILTER (in_aoi AND class = 'snow') AS snow_px,
  count(*) FILTER (in_aoi AND class = 'other_masked') AS other_masked_px, count(*) FILTER (in_aoi AND class = 'invalid_spectral') AS invalid_spectral_px,
  count(*) FILTER (in_aoi AND class = 'valid') AS valid_px, count(*) FILTER (zero_den) AS zero_den_px,
  round(100.0 * count(*) FILTER (in_aoi AND covered) / count(*) FILTER (in_aoi), 4) AS coverage_pct, round(100.0 * count(*) FILTER (in_aoi AND class = 'cloud') / count(*) FILTER (in_aoi), 4) AS cloud_pct FROM ix GROUP BY 1),
gt AS (SELECT st.*, covered_px, coverage_pct, CASE WHEN covered_px = 0 THEN 'no_raster_overlap_with_aoi' WHEN 100.0 * covered_px / st.aoi_px < 95 THEN 'insufficient_aoi_coverage'
  WHEN st.valid_px = 0 THEN 'all_pixels_masked' WHEN valid_pixel_pct < 10 THEN 'insufficient_valid_pixels' END AS reason FROM st JOIN cv USING (acquisition))
"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings").select("vec_id", "embedding")
    acq = F.floor(F.col("vec_id") / 2).cast("long").alias("acquisition")
    red = e.where("vec_id % 2 = 0").select(acq, F.col("vec_id").alias("red_id"), F.col("embedding").alias("r"))
    nir = e.where("vec_id % 2 = 1").select(acq, F.col("embedding").alias("n"))
    px = red.join(nir, "acquisition").select("acquisition", "red_id", F.posexplode(F.arrays_zip("r", "n")).alias("pos", "v"))
    k = F.col("acquisition") + F.col("pos")
    dn = lambda v: F.floor((v.cast("double") + 1) * 5000).cast("int")
    row, col = F.floor(F.col("pos") / 8).cast("long"), (F.col("pos") % 8).cast("long")
    return px.select(
        "acquisition", F.col("pos").cast("long").alias("pos"), row.alias("row"), col.alias("col"),
        F.when(k % 31 == 0, F.lit(None)).when(k % 37 == 0, 1000).otherwise(dn(F.col("v.r"))).alias("red_dn"), F.when(k % 37 == 0, 1000).otherwise(dn(F.col("v.n"))).alias("nir_dn"),
        ((F.col("red_id") * 7 + F.col("pos") * 5) % 12).alias("scl"), (k % 29 != 0).alias("covered"), (row.between(1, 6) & col.between(1, 6)).alias("in_aoi"),
    )


def indexed(spark: SparkSession, d: str) -> DataFrame:
    return raster.index_pixels(pixels(spark, d))


@query(PIX + "SELECT acquisition, row, col, round(ndvi, 6) AS ndvi, zero_den, class FROM (SELECT * REPLACE (CAST(ndvi AS DOUBLE) AS ndvi) FROM ix)")
def ndvi_pixels(spark, d):
    return indexed(spark, d).select("acquisition", "row", "col", F.round(F.col("ndvi").cast("double"), 6).alias("ndvi"), "zero_den", "class")


@query(PIX + "SELECT * FROM st")
def ndvi_scene_stats(spark, d):
    return raster.scene_stats(indexed(spark, d))


@query(PIX + "SELECT * FROM cv")
def coverage_stats(spark, d):
    return raster.coverage_stats(indexed(spark, d))


@query(PIX + "SELECT class, count(*) AS px, count(*) FILTER (in_aoi) AS aoi_px FROM ix GROUP BY 1")
def ndvi_coverage_classes(spark, d):
    return indexed(spark, d).groupBy("class").agg(F.count("*").alias("px"), F.count_if("in_aoi").alias("aoi_px"))


@query(PIX + "SELECT scl, ok AS valid, count(*) AS px FROM ix GROUP BY 1, 2")
def scl_mask(spark, d):
    return indexed(spark, d).groupBy("scl", F.col("valid_mask").alias("valid")).agg(F.count("*").alias("px"))


def _gated(spark, d):
    return raster.gate(raster.scene_summary(indexed(spark, d)), min_coverage=95.0)


@query(PIX + "SELECT acquisition, reason IS NULL AS usable, reason FROM gt")
def usable_gate(spark, d):
    return _gated(spark, d).select("acquisition", "usable", "reason")


@query(PIX + "SELECT acquisition, CAST(DATE '2024-01-01' + CAST(acquisition AS INT) AS DATE) AS observed_on, ndvi_mean, ndvi_median, ndvi_std, ndvi_p25, ndvi_p75, valid_px, masked_px, valid_pixel_pct, coverage_pct FROM gt WHERE reason IS NULL")
def timeseries_rows(spark, d):
    day = F.date_add(F.lit(date(2024, 1, 1)), F.col("acquisition").cast("int")).alias("observed_on")
    return _gated(spark, d).where("usable").select("acquisition", day, "ndvi_mean", "ndvi_median", "ndvi_std", "ndvi_p25", "ndvi_p75", "valid_px", "masked_px", "valid_pixel_pct", "coverage_pct")


@query(PIX + "SELECT count(*) FILTER (reason IS NULL) AS usable, count(*) FILTER (reason IS NOT NULL) AS unusable, round(arg_max(ndvi_mean, acquisition) FILTER (reason IS NULL) - arg_min(ndvi_mean, acquisition) FILTER (reason IS NULL), 6) AS ndvi_change, round(avg(valid_pixel_pct) FILTER (reason IS NULL), 6) AS mean_valid_pct, min(coverage_pct) FILTER (reason IS NULL) AS min_coverage_pct FROM gt")
def analysis_summary(spark, d):
    ok = F.col("usable")
    mean, at = F.when(ok, F.col("ndvi_mean")), F.when(ok, F.col("acquisition"))
    change = F.max_by(mean, at) - F.min_by(mean, at)
    return _gated(spark, d).agg(F.count_if(ok).alias("usable"), F.count_if(~ok).alias("unusable"), F.round(change, 6).alias("ndvi_change"), F.round(F.avg(F.when(ok, F.col("valid_pixel_pct"))), 6).alias("mean_valid_pct"), F.min(F.when(ok, F.col("coverage_pct"))).alias("min_coverage_pct"))


@query(PIX + """, ab AS (SELECT *, CAST((CASE WHEN nir_dn < 0 THEN 0 ELSE nir_dn END - red_dn) AS DOUBLE) / nullif(nir_dn + red_dn, 0) AS raw, CAST((n0 - r0) / nullif(n0 + r0, 0) AS DOUBLE) AS all_ FROM ix WHERE in_aoi)
SELECT acquisition, round(avg(all_) FILTER (ok), 6) AS as_shipped, round(avg(all_), 6) AS unmasked, round(avg(raw) FILTER (ok), 6) AS no_offset, round(100.0 * count(*) FILTER (NOT ok) / count(*), 4) AS masked_pct FROM ab GROUP BY 1""")
def offset_ablation(spark, d):
    ix = indexed(spark, d).where("in_aoi")
    r, n = raster._clip(F.col("red")), raster._clip(F.col("nir"))
    full = F.try_divide(n - r, F.nullif(n + r, F.lit(0.0)))
    bare = F.try_divide((F.col("nir_dn") - F.col("red_dn")).cast("double"), F.nullif(F.col("nir_dn") + F.col("red_dn"), F.lit(0)).cast("double"))
    ok = F.col("valid_mask")
    return ix.groupBy("acquisition").agg(F.round(F.avg(F.when(ok, full)), 6).alias("as_shipped"), F.round(F.avg(full), 6).alias("unmasked"), F.round(F.avg(F.when(ok, bare)), 6).alias("no_offset"), F.round(100.0 * F.count_if(~ok) / F.count("*"), 4).alias("masked_pct"))


@query("""WITH g AS (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
m AS (SELECT label, pos, vec_id, CASE WHEN (vec_id + pos) % 5 = 0 THEN NULL ELSE CAST(v AS DOUBLE) END AS v FROM g)
SELECT CAST(label AS BIGINT) AS label, pos, round(arg_min(v, vec_id) FILTER (v IS NOT NULL), 6) AS value, min(vec_id) FILTER (v IS NOT NULL) AS winner, count(*) AS n_items FROM m GROUP BY 1, 2""")
def mosaic_first_valid(spark, d):
    g = _t(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id", F.posexplode("embedding").alias("pos", "v"))
    g = g.select("label", F.col("pos").cast("long").alias("pos"), F.col("vec_id").alias("item_id"), F.when((F.col("vec_id") + F.col("pos")) % 5 != 0, F.col("v").cast("double")).alias("value"))
    return raster.mosaic_first_valid(g, ["label", "pos"]).withColumn("value", F.round("value", 6))


@query(PIX + "SELECT acquisition, row, col, CAST(trunc(least(greatest((CAST(ndvi AS DOUBLE) + 0.2) / 1.1, 0), 1) * 255) AS INT) AS colour FROM ix WHERE ndvi IS NOT NULL AND row % 2 = 0 AND col % 2 = 0")
def colour_index(spark, d):
    ix = raster.decimate(indexed(spark, d), 8, 4).where(F.col("ndvi").isNotNull())
    return ix.select("acquisition", "row", "col", raster.colour_index(F.col("ndvi")).alias("colour"))


@query(PIX + "SELECT a.acquisition, a.row, a.col, round(CAST(b.ndvi AS DOUBLE) - CAST(a.ndvi AS DOUBLE), 6) AS change FROM ix a JOIN ix b ON a.row = b.row AND a.col = b.col AND b.acquisition = a.acquisition + 1 WHERE a.ndvi IS NOT NULL AND b.ndvi IS NOT NULL")
def change_map(spark, d):
    ix = indexed(spark, d).where("ndvi is not null").select("acquisition", "row", "col", "ndvi")
    later = ix.select((F.col("acquisition") - 1).alias("acquisition"), "row", "col", F.col("ndvi").alias("later"))
    return ix.join(later, ["acquisition", "row", "col"]).select("acquisition", "row", "col", F.round(F.col("later").cast("double") - F.col("ndvi").cast("double"), 6).alias("change"))


# -- scaling, geometry ---------------------------------------------------------------------------------
@query("""WITH b AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'x.y' ELSE '0' || (p_size % 7) || '.0' || (p_size % 3) END AS baseline FROM part), n AS (SELECT *, try_cast(baseline AS DOUBLE) AS v FROM b)
SELECT p_partkey, baseline, CASE WHEN v < 4 THEN 0.0 ELSE -0.1 END::DOUBLE AS "offset", CASE WHEN v IS NULL THEN 'default' ELSE 'baseline_heuristic' END AS source FROM n""")
def band_scaling(spark, d):
    s = F.col("p_size")
    baseline = F.when(s % 5 == 0, F.lit(None)).when(s % 5 == 1, "x.y").otherwise(F.concat(F.lit("0"), (s % 7).cast("string"), F.lit(".0"), (s % 3).cast("string")))
    rows = _t(spark, d, "part").select("p_partkey", baseline.alias("baseline"))
    b = raster.band_scaling(F.col("baseline"))
    return rows.select("p_partkey", "baseline", b["offset"].alias("offset"), b["source"].alias("source"))




def _points(spark, d):
    k = F.col("c_custkey")
    return _t(spark, d, "customer").select("c_custkey", ((k * 37 % 3600).cast("double") / 10 - 180).alias("lon"), ((k * 53 % 1600).cast("double") / 10 - 80).alias("lat"))


_POINTS = "WITH p AS (SELECT c_custkey, CAST(c_custkey * 37 % 3600 AS DOUBLE) / 10 - 180 AS lon, CAST(c_custkey * 53 % 1600 AS DOUBLE) / 10 - 80 AS lat FROM customer)"


@query(_POINTS + " SELECT c_custkey, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS BIGINT) % 60 + 1 AS INT) AS epsg FROM p")
def utm_zone(spark, d):
    return _points(spark, d).select("c_custkey", geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query(_POINTS + " SELECT c_custkey, floor(lon * 1000 / 10) * 10 AS low, ceil((lon * 1000 + 255.5) / 10) * 10 AS high, CAST((ceil((lon * 1000 + 255.5) / 10) * 10 - floor(lon * 1000 / 10) * 10) / 10 AS BIGINT) AS cells FROM p")
def grid_snap(spark, d):
    low, high, cells = geo.snap(F.col("lon") * 1000, F.col("lon") * 1000 + 255.5, 10)
    return _points(spark, d).select("c_custkey", low.alias("low"), high.alias("high"), cells.alias("cells"))


@query(_POINTS + """ , b AS (SELECT c_custkey, lon AS w, lat AS s, CASE c_custkey % 7 WHEN 0 THEN lon WHEN 1 THEN lon + 400 ELSE lon + 0.5 END AS e, CASE c_custkey % 5 WHEN 0 THEN lat - 1 WHEN 1 THEN NULL ELSE lat + 0.5 END AS n FROM p)
SELECT c_custkey, CASE WHEN n IS NULL THEN 'not_finite' WHEN w < -180 OR e > 180 OR w > 180 OR e < -180 THEN 'longitude_range' WHEN s < -90 OR n > 90 OR s > 90 OR n < -90 THEN 'latitude_range' WHEN w >= e THEN 'west_not_below_east' WHEN s >= n THEN 'south_not_below_north' END AS problem FROM b""")
def bbox_validate(spark, d):
    k, lon, lat = F.col("c_custkey"), F.col("lon"), F.col("lat")
    e = F.when(k % 7 == 0, lon).when(k % 7 == 1, lon + 400).otherwise(lon + 0.5)
    n = F.when(k % 5 == 0, lat - 1).when(k % 5 == 1, F.lit(None)).otherwise(lat + 0.5)
    return _points(spark, d).select("c_custkey", geo.bbox_problem(lon, lat, e, n).alias("problem"))


def _zonal_sql(lat: str) -> str:
    x = f"sin(radians({lat}))"
    return f"({geo.A!r} * {geo.A!r} * {1 - geo.E2!r} / 2 * ({x} / (1 - {geo.E2!r} * {x} * {x}) + ln((1 + {geo.E!r} * {x}) / (1 - {geo.E!r} * {x})) / (2 * {geo.E!r})))"


def _area_sql(w: str, s: str, e: str, n: str) -> str:
    return f"abs(radians(({e}) - ({w})) * ({_zonal_sql(n)} - {_zonal_sql(s)})) / 1e6"


@query(_POINTS + f" , q AS (SELECT c_custkey, lon AS w, lat AS s, lon + 1 AS e, lat + 1 AS n, lon + (c_custkey % 4) * 0.4 AS w2, lon + (c_custkey % 4) * 0.4 + 1 AS e2 FROM p) SELECT c_custkey, round({_area_sql('w', 's', 'e', 'n')}, 4) AS area_km2, round(CASE WHEN greatest(w, w2) < least(e, e2) THEN 100 * {_area_sql('greatest(w, w2)', 's', 'least(e, e2)', 'n')} / ({_area_sql('w', 's', 'e', 'n')}) ELSE 0 END, 4) AS overlap_pct FROM q")
def bbox_intersection_pct(spark, d):
    lon, lat, shift = F.col("lon"), F.col("lat"), (F.col("c_custkey") % 4) * 0.4
    a, b = (lon, lat, lon + 1, lat + 1), (lon + shift, lat, lon + shift + 1, lat + 1)
    return _points(spark, d).select("c_custkey", F.round(geo.bbox_area_km2(*a), 4).alias("area_km2"), F.round(geo.bbox_overlap_pct(a, b), 4).alias("overlap_pct"))


# -- acquisitions, selection, catalogue ----------------------------------------------------------------
@query(r"""WITH i AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'not_a_product' ELSE 'S2A_MSIL2A_' || strftime(ts, '%Y%m%dT%H%M%S') || '_R' || lpad(CAST(user_id % 144 AS VARCHAR), 3, '0') || '_T17TLG_' || strftime(ts, '%Y%m%dT%H%M%S') END AS id FROM events)
SELECT event_id, nullif(regexp_extract(id, '_(R\d{3})_', 1), '') AS orbit, nullif(regexp_extract(id, '_(T\d\d[A-Z]{3})_', 1), '') AS tile FROM i""")
def product_id_parse(spark, d):
    at = F.date_format("ts", "yyyyMMdd'T'HHmmss")
    pid = F.when(F.col("event_id") % 9 == 0, "not_a_product").otherwise(F.concat(F.lit("S2A_MSIL2A_"), at, F.lit("_R"), F.lpad((F.col("user_id") % 144).cast("string"), 3, "0"), F.lit("_T17TLG_"), at))
    return _t(spark, d, "events").select("event_id", pid.alias("id")).select("event_id", acquisition.product_part(F.col("id"), 4).alias("orbit"), acquisition.product_part(F.col("id"), 5).alias("tile"))


_GRAN = """WITH g AS (SELECT event_id AS item_id, ts, event_type AS platform, CAST(json_extract(props, '$.k') AS DOUBLE) AS cloud, least(value, 100) AS overlap,
 's2|' || lower(event_type) || '|R00' || (user_id % 8) || '|' || strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S+00:00') AS key FROM events)"""


def _granules(spark, d):
    e = _t(spark, d, "events")
    key = acquisition.acquisition_key(F.lit("s2"), F.col("event_type"), F.concat(F.lit("R00"), (F.col("user_id") % 8).cast("string")), F.col("ts"), "hour")
    cloud = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("event_id").alias("item_id"), "ts", F.col("event_type").alias("platform"), cloud.alias("cloud"), F.least("value", F.lit(100.0)).alias("overlap"), key.alias("key"))


@query(_GRAN + " SELECT item_id, key FROM g")
def acquisition_key(spark, d):
    return _granules(spark, d).select("item_id", "key")


@query(_GRAN + """ SELECT key, count(*) AS granule_count, min(ts) AS observed_at, arg_min(platform, item_id) AS platform, arg_max(item_id, (overlap, item_id)) AS primary_item,
 round(sum(cloud * greatest(overlap, 1e-6)) / sum(CASE WHEN cloud IS NOT NULL THEN greatest(overlap, 1e-6) END), 6) AS cloud, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM g GROUP BY 1""")
def acquisition_group(spark, d):
    return acquisition.group_acquisitions(_granules(spark, d))


_ORD = """WITH a AS (SELECT CAST(o_orderkey AS BIGINT) AS key, o_orderdate AS ts, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE round(o_totalprice % 40, 2) END AS cloud, CASE WHEN o_orderkey % 13 = 0 THEN 56.2 ELSE 100.0 END::DOUBLE AS coverage, o_custkey % 7 AS analysis FROM orders),
g AS (SELECT *, CASE WHEN coverage < 99 THEN 'insufficient_aoi_coverage' WHEN cloud > 20 THEN 'cloud_cover_above_threshold' END AS gate, coalesce(cloud, 101) AS ck FROM a)"""


def _orders(spark, d):
    k = F.col("o_orderkey")
    cloud = F.when(k % 10 != 0, F.round(F.col("o_totalprice") % 40, 2))
    return _t(spark, d, "orders").select(k.cast("long").alias("key"), F.col("o_orderdate").alias("ts"), cloud.alias("cloud"), F.when(k % 13 == 0, 56.2).otherwise(100.0).alias("coverage"), (F.col("o_custkey") % 7).alias("analysis"))


@query(_ORD + """, b AS (SELECT *, least(greatest(CAST(floor(epoch(ts - TIMESTAMP '1996-01-01') / (epoch(TIMESTAMP '2000-12-31' - TIMESTAMP '1996-01-01') / 8.0)) AS BIGINT), 0), 7) AS bucket, count(*) FILTER (gate IS NULL) OVER (PARTITION BY analysis) AS n_ok FROM g),
f AS (SELECT *, gate IS NULL AND row_number() OVER (PARTITION BY analysis, gate IS NULL, bucket ORDER BY ck, ts, key) = 1 AS first FROM b),
p AS (SELECT *, count(*) FILTER (first) OVER (PARTITION BY analysis) AS picked, row_number() OVER (PARTITION BY analysis, gate IS NULL, first ORDER BY ck, ts, key) AS rest FROM f),
s AS (SELECT *, gate IS NULL AND (n_ok <= 8 OR first OR rest <= 8 - picked) AS selected FROM p)
SELECT key, ts, cloud, coverage, analysis, selected, CASE WHEN NOT selected THEN coalesce(gate, 'not_selected_temporal_sampling') END AS reason FROM s""")
def select_temporal(spark, d):
    return selection.select_temporal(_orders(spark, d), F.lit("1996-01-01").cast("timestamp"), F.lit("2000-12-31").cast("timestamp"), 8)


_DOY = "least(abs(date_diff('day', make_date(year(ts), 7, 15), CAST(ts AS DATE))), date_diff('day', make_date(year(ts), 1, 1), make_date(year(ts) + 1, 1, 1)) - abs(date_diff('day', make_date(year(ts), 7, 15), CAST(ts AS DATE))))"


@query(_ORD + f", x AS (SELECT *, {_DOY} AS distance FROM a)" + """, g2 AS (SELECT *, year(ts) AS y, coalesce(ck, 101) AS c2, coalesce(gate, CASE WHEN distance > 30 THEN 'outside_seasonal_window' END) AS gt FROM (SELECT x.*, g.gate, g.ck FROM x JOIN g USING (key))),
f AS (SELECT *, gt IS NULL AND row_number() OVER (PARTITION BY analysis, gt IS NULL, y ORDER BY c2, distance, key) = 1 AS first, dense_rank() OVER (PARTITION BY analysis, gt IS NULL ORDER BY y) - 1 AS place FROM g2),
n AS (SELECT *, count(*) FILTER (first) OVER (PARTITION BY analysis) AS years FROM f),
k AS (SELECT *, years <= 4 OR list_contains(list_transform(range(4), lambda i: CAST(round_even(i * (years - 1) / 3.0, 0) AS BIGINT)), place) AS year_kept FROM n)
SELECT key, ts, cloud, coverage, analysis, CAST(distance AS INT) AS distance, first AND year_kept AS selected, CASE WHEN NOT (first AND year_kept) THEN coalesce(gt, CASE WHEN NOT year_kept THEN 'not_selected_year_sampling' ELSE 'not_selected_temporal_sampling' END) END AS reason FROM k""")
def select_seasonal(spark, d):
    return selection.select_seasonal(_orders(spark, d), 7, 15, 30, 4)


@query(_ORD + f" SELECT key, CAST({_DOY} AS INT) AS distance FROM a")
def doy_distance(spark, d):
    return _orders(spark, d).select("key", selection.day_distance(F.col("ts"), 7, 15).alias("distance"))


@query(_GRAN + """, w(window_id, ws, we) AS (VALUES (0, DATE '2024-01-01', DATE '2024-01-08'), (1, DATE '2024-01-09', DATE '2024-01-16'), (2, DATE '2024-01-17', DATE '2024-01-24'), (3, DATE '2024-01-25', DATE '2024-01-30')),
h AS (SELECT item_id, ts, cloud, window_id, row_number() OVER (PARTITION BY window_id ORDER BY ts, item_id) AS rn, count(*) OVER (PARTITION BY window_id) AS found FROM g JOIN w ON CAST(ts AS DATE) BETWEEN ws AND we WHERE cloud < 30)
SELECT item_id, ts, cloud, CAST(window_id AS INT) AS window_id, found >= 150 AS truncated FROM h WHERE rn <= 150""")
def catalog_search_capped(spark, d):
    return catalog.search(_granules(spark, d), catalog.windows(spark, date(2024, 1, 1), date(2024, 1, 30), 8), 30.0, 150)


# -- store-shaped reads --------------------------------------------------------------------------------
@query("SELECT o_orderkey, l_linenumber, l_partkey, o_orderdate, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def ts_join(spark, d):
    """Every observation beside its scene."""
    scenes = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    line = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("scene_id"), "l_linenumber", "l_partkey", "l_shipdate")
    return store.observations_of_scenes(line, scenes).select(F.col("scene_id").alias("o_orderkey"), "l_linenumber", "l_partkey", "o_orderdate", "l_shipdate")


@query("SELECT c_custkey, o_orderkey, coalesce(CAST(o_orderkey AS VARCHAR), 'unattributed') AS item FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'")
def artifacts_outer_join(spark, d):
    o = _t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    c = _t(spark, d, "customer").select("c_custkey")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "o_orderkey", store.artifact_group(F.col("o_orderkey"), F.lit(None)).alias("item"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def list_paginated(spark, d):
    return store.page(_t(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 20, 40)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def latest_demo(spark, d):
    return store.page(_t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 1, 0)


@query("SELECT r_name, CAST(CASE r_name WHEN 'AMERICA' THEN 0 WHEN 'ASIA' THEN 1 ELSE 2 END AS INT) AS rank, string_agg(n_name, ',' ORDER BY n_name) AS members FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def region_grouping(spark, d):
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    rank = F.when(F.col("r_name") == "AMERICA", 0).when(F.col("r_name") == "ASIA", 1).otherwise(2).alias("rank")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name", rank).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("members"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sum(l_quantity) OVER w, 2) AS charged, sum(l_quantity) OVER w > 100 AS over_budget FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING)")
def storage_budget_running(spark, d):
    rows = store.charge(_t(spark, d, "lineitem"), "l_orderkey", "l_quantity", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], 100)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("charged", 2).alias("charged"), "over_budget")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour FROM events")
def rate_limit_window(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return _t(spark, d, "events").select("event_id", F.count("*").over(w).alias("in_hour"))


@query("SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents")
def sha256_artifacts(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_props(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT user_id, CASE WHEN count(*) >= 2 THEN min(event_id) END AS first_id, CASE WHEN count(*) >= 2 THEN arg_max(event_id, (ts, event_id)) END AS last_id FROM (SELECT user_id, ts, event_id, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events) GROUP BY 1".replace("min(event_id)", "min(f)"))
def comparison_points(spark, d):
    ends = store.comparison_points(_t(spark, d, "events"), "user_id", "ts", "event_id")
    return ends.select("user_id", F.col("first.event_id").alias("first_id"), F.col("last.event_id").alias("last_id"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_existing(spark, d):
    """Customers for whom no open order is stored yet."""
    c, o = _t(spark, d, "customer").select("c_custkey"), _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return stac_items.fresh(c, o, "c_custkey")


@query("SELECT coalesce(n.k, o.k) AS n_nationkey, coalesce(n.v, o.v) AS n_name FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 20) o FULL JOIN (SELECT n_nationkey AS k, lower(n_name) AS v FROM nation WHERE n_nationkey >= 10) n USING (k)")
def region_upsert(spark, d):
    n = _t(spark, d, "nation").select("n_nationkey", "n_name")
    new = n.where("n_nationkey >= 10").select("n_nationkey", F.lower("n_name").alias("n_name"))
    return store.upsert(n.where("n_nationkey < 20"), new, "n_nationkey")


@query("SELECT event_id, event_type = 'click' OR (event_type = 'view' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 2 HOUR) AS claimable FROM events")
def stale_lease_claim(spark, d):
    kind = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "running")
    rows = _t(spark, d, "events").select("event_id", kind.alias("status"), F.col("ts").alias("started_at"))
    return rows.select("event_id", F.coalesce(jobs.may_claim(F.lit("2024-01-15").cast("timestamp_ntz")), F.lit(False)).alias("claimable"))


@query("SELECT p_partkey, coalesce(try_cast(split_part(v, '.', 1) AS INT), 0) AS major, coalesce(try_cast(split_part(v, '.', 1) AS INT), 0) < 2 AS legacy FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'v2' ELSE (p_size % 4) || '.0.' || p_size END AS v FROM part)")
def legacy_version_filter(spark, d):
    s = F.col("p_size")
    v = F.when(s % 4 == 0, F.lit(None)).when(s % 4 == 1, "v2").otherwise(F.concat((s % 4).cast("string"), F.lit(".0."), s.cast("string")))
    major = store.major_version(v)
    return _t(spark, d, "part").select("p_partkey", major.alias("major"), (major < 2).alias("legacy"))


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderdate < DATE '1996-01-01' THEN 'too_early' END, CASE WHEN o_totalprice > 300000 THEN 'area_above_limit' END, CASE WHEN o_custkey % 15 > 12 THEN 'scene_limit' END) AS problems FROM orders")
def request_validation(spark, d):
    early = F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), "too_early")
    return _t(spark, d, "orders").select("o_orderkey", F.concat_ws(",", early, F.when(F.col("o_totalprice") > 300000, "area_above_limit"), F.when(F.col("o_custkey") % 15 > 12, "scene_limit")).alias("problems"))
