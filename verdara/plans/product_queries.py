"""Projection, polygons, resampling, catalogue items and reader views over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdara.functions import json_schema, projection, views
from verdara.functions.geo import E, utm_epsg
from verdara.operators import raster
from verdara.plans.queries import _POINTS, _points, _t, pixels, query
from verdara.sinks import documents, images
from verdara.sources import stac_items
from verdara.plans.registry import QUERIES, SQL

_SER = projection.SERIES
_UTM_SQL = (
    _POINTS
    + f""", z AS (SELECT *, CAST(floor((lon + 180) / 6) AS INT) % 60 + 1 AS zone FROM p),
t AS (SELECT *, radians(lon - (zone * 6 - 183)) AS turn, sinh(atanh(sin(radians(lat))) - {E!r}::DOUBLE * atanh({E!r}::DOUBLE * sin(radians(lat)))) AS t FROM z),
u AS (SELECT *, atan2(t, cos(turn)) AS xi, atanh(sin(turn) / sqrt(1 + t * t)) AS eta FROM t)
SELECT c_custkey, round(500000 + {projection.K0 * projection.RADIUS!r}::DOUBLE * (eta """
    + " ".join(f"+ {c!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(_SER, 1))
    + f"), 2) AS easting, round({projection.K0 * projection.RADIUS!r}::DOUBLE * (xi "
    + " ".join(f"+ {c!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(_SER, 1))
    + ") + CASE WHEN lat >= 0 THEN 0 ELSE 10000000 END, 2) AS northing FROM u"
)


@query(_UTM_SQL)
def utm_project(spark, d):
    lon, lat = F.col("lon"), F.col("lat")
    x, y = projection.utm_xy(lon, lat, utm_epsg(lon, lat))
    return _points(spark, d).select("c_custkey", F.round(x, 2).alias("easting"), F.round(y, 2).alias("northing"))


# -- a dented ring for each nation; dents make it other than convex ------------------------------------
_SHAPE = ((0.0, 0.0), (8.0, 1.0), (10.0, 9.0), (5.0, 4.0), (1.0, 10.0))


def _rings(spark, d):
    k = F.col("n_nationkey")
    ring = F.array(*[F.struct((x + k % 3).cast("double").alias("x"), (y + k * 0.25).cast("double").alias("y")) for x, y in ((F.lit(x), F.lit(y)) for x, y in _SHAPE)])
    return _t(spark, d, "nation").select("n_nationkey", ring.alias("ring"))


_SIDES = "WITH s(i, px, py, qx, qy) AS (VALUES " + ", ".join(f"({i}, {p[0]}::DOUBLE, {p[1]}::DOUBLE, {q[0]}::DOUBLE, {q[1]}::DOUBLE)" for i, (p, q) in enumerate(zip(_SHAPE, _SHAPE[1:] + _SHAPE[:1]))) + """),
e AS (SELECT n_nationkey, px + n_nationkey % 3 AS px, py + n_nationkey * 0.25::DOUBLE AS py, qx + n_nationkey % 3 AS qx, qy + n_nationkey * 0.25::DOUBLE AS qy FROM nation, s)"""


@query(_SIDES + """, c AS (SELECT r.range AS row, c.range AS col, (c.range + 0.5) AS x, 18 - (r.range + 0.5) AS y FROM range(18) r, range(14) c)
SELECT n_nationkey, CAST(row AS INT) AS row, CAST(col AS INT) AS col, count(*) FILTER ((py > y) <> (qy > y) AND x < (qx - px) * (y - py) / nullif(qy - py, 0) + px) % 2 = 1 AS in_aoi FROM e, c GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY n_nationkey, row, col"))
def aoi_rasterize(spark, d):
    return projection.rasterize(_rings(spark, d), "ring", 14, 18, 1.0, F.lit(0.0), F.lit(18.0)).drop("ring")


# -- resampling: tiles of 8 x 8 cells of 20 m onto 14 x 14 cells of 10 m, from an offset of 7 m ---------
_SRC = "WITH s AS (SELECT vec_id AS key, pos // 8 AS row, pos % 8 AS col, CASE WHEN (vec_id + pos) % 13 = 0 THEN NULL ELSE v END AS value FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)), c AS (SELECT r.range AS row, c.range AS col, 7 + (c.range + 0.5::DOUBLE) * 10 AS x, 153 - (r.range + 0.5::DOUBLE) * 10 AS y FROM range(14) r, range(14) c)"


def _source(spark, d):
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.posexplode("embedding").alias("pos", "v"))
    value = F.when((F.col("key") + F.col("pos")) % 13 != 0, F.col("v").cast("double"))
    return rows.select("key", F.floor(F.col("pos") / 8).alias("row"), (F.col("pos") % 8).cast("long").alias("col"), value.alias("value"))


def _cells(spark):
    c = spark.range(14 * 14).select(F.floor(F.col("id") / 14).alias("row"), (F.col("id") % 14).alias("col"))
    return c.select("row", "col", (7 + (F.col("col") + 0.5) * 10).alias("x"), (153 - (F.col("row") + 0.5) * 10).alias("y"))


@query(_SRC + " SELECT s.key, c.row, c.col, s.value FROM c JOIN s ON s.row = floor((160 - y) / 20) AND s.col = floor(x / 20)")
def resample_nearest(spark, d):
    return raster.resample_nearest(_cells(spark), _source(spark, d), 20.0, 0.0, 160.0)


@query(_SRC + """, b AS (SELECT *, x / 20 - 0.5::DOUBLE AS u, (160 - y) / 20 - 0.5::DOUBLE AS v FROM c), n AS (SELECT row, col, floor(v) + i AS r, floor(u) + j AS k,
  (CASE i WHEN 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) * (CASE j WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) AS w FROM b, (VALUES (0), (1)) a(i), (VALUES (0), (1)) a2(j))
SELECT s.key, n.row, n.col, round(sum(w * value) / sum(w), 6) + 0 AS value FROM n JOIN s ON s.row = n.r AND s.col = n.k WHERE value IS NOT NULL AND w > 0 GROUP BY 1, 2, 3""")
def resample_bilinear(spark, d):
    return raster.resample_bilinear(_cells(spark), _source(spark, d), 20.0, 0.0, 160.0).withColumn("value", F.round("value", 6) + 0)


@query("""WITH g AS (SELECT label, vec_id, vec_id % 3 AS band, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
f AS (SELECT label, pos, band, arg_min((v + 0.1::DOUBLE) * 900, vec_id) FILTER ((vec_id + pos) % 7 <> 0) AS v FROM g GROUP BY 1, 2, 3),
w AS (SELECT label, pos, max(v) FILTER (band = 0) AS r, max(v) FILTER (band = 1) AS g, max(v) FILTER (band = 2) AS b FROM f GROUP BY 1, 2)
SELECT label, CAST(pos AS INT) AS pos, CAST(trunc(least(greatest(coalesce(r, 0), 0), 255)) AS INT) AS red, CAST(trunc(least(greatest(coalesce(g, 0), 0), 255)) AS INT) AS green, CAST(trunc(least(greatest(coalesce(b, 0), 0), 255)) AS INT) AS blue FROM w""")
def rgb_mosaic(spark, d):
    rows = _t(spark, d, "embeddings").select("label", F.col("vec_id").alias("item_id"), F.posexplode("embedding").alias("pos", "v"))
    band = F.element_at(F.array(F.lit("red"), F.lit("green"), F.lit("blue")), (F.col("item_id") % 3 + 1).cast("int"))
    value = F.when((F.col("item_id") + F.col("pos")) % 7 != 0, (F.col("v").cast("double") + 0.1) * 900)
    return raster.mosaic_rgb(rows.select("label", "pos", "item_id", band.alias("band"), value.alias("value")), ["label", "pos"])


def _true_colour(spark, d):
    pos = F.col("pos")
    m = rgb_mosaic(spark, d).select("label", F.floor(pos / 8).alias("row"), (pos % 8).alias("col"), "red", "green", "blue", (pos >= 8).alias("valid"))
    return raster.true_colour(m, 8, 4)


@query(f"""WITH m AS ({SQL["rgb_mosaic"]}) SELECT label, CAST(pos // 16 AS INT) AS row, CAST(pos % 8 // 2 AS INT) AS col, red AS r, green AS g, blue AS b, CASE WHEN pos >= 8 THEN 255 ELSE 0 END AS alpha
FROM m WHERE pos // 8 % 2 = 0 AND pos % 2 = 0""")
def true_colour_pixels(spark, d):
    return _true_colour(spark, d)


def true_colour_previews(spark, d):
    """PNG bytes of each label's mosaic in natural colours, by digest; the tests decode them."""
    return images.png_images(_true_colour(spark, d), "label").select("label", F.length("content").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


QUERIES["true_colour_previews"] = true_colour_previews

_STOPS = "WITH s(p, r, g, b) AS (VALUES " + ", ".join(f"({p}::DOUBLE, {c[0]}, {c[1]}, {c[2]})" for p, c in views.STOPS) + "), t AS (SELECT *, lead(p) OVER o AS p2, lead(r) OVER o AS r2, lead(g) OVER o AS g2, lead(b) OVER o AS b2 FROM s WINDOW o AS (ORDER BY p))"


@query(_STOPS + ", x AS (SELECT range AS i, range / 255.0::DOUBLE AS place FROM range(256)) SELECT CAST(i AS INT) AS i, " + ", ".join(f"CAST(trunc(CASE WHEN place = 1 THEN {c}2 ELSE (place - p) * (({c}2 - {c}) / (p2 - p)) + {c} END) AS INT) AS {c}" for c in "rgb") + " FROM x JOIN t ON (place >= p AND place < p2) OR (place = 1 AND p2 = 1)")
def colour_table(spark, d):
    return views.colour_table(spark)


@query(_STOPS + " SELECT p AS position, printf('#%02x%02x%02x', r, g, b) AS colour, round(-0.2::DOUBLE + p * 1.1::DOUBLE, 3) AS value FROM s")
def legend_spec(spark, d):
    return views.legend(spark, -0.2, 0.9)


_ITEM = """WITH i AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id END AS red, event_id % 4 AS m, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, ts, CAST(json_extract(props, '$.k') AS DOUBLE) AS cloud FROM events)"""


@query(_ITEM + """ SELECT 'e' || event_id AS item_id, CASE WHEN m = 0 THEN 'unknown' ELSE 'c' || m END AS collection, CASE WHEN m = 3 THEN NULL ELSE cloud END AS cloud_cover_pct,
CASE m WHEN 0 THEN 32617 WHEN 1 THEN 32618 END AS epsg, CASE WHEN red IS NULL THEN 'missing_assets:red=B04' WHEN m = 2 AND event_id % 5 = 0 THEN 'no_geometry' END AS problem FROM i""")
def stac_items_project(spark, d):
    k, m = F.col("event_id").cast("string"), F.col("event_id") % 4
    red = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit('"B04":{"href":"r'), k, F.lit('"},')))
    crs = F.when(m == 0, ',"proj:epsg":32617').when(m == 1, ',"proj:code":"epsg:32618"').when(m == 2, ',"proj:code":"none"').otherwise("")
    cloud = F.when(m == 3, "null").otherwise(F.get_json_object("props", "$.k"))
    shape = F.when((m == 2) & (F.col("event_id") % 5 == 0), "").otherwise(',"geometry":{"type":"Polygon","coordinates":[]},"bbox":[0,0,1,1]')
    own = F.when(m == 0, "").otherwise(F.concat(F.lit(',"collection":"c'), m.cast("string"), F.lit('"')))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.concat(F.lit('{"id":"e'), k, F.lit('"'), own, shape, F.lit(',"assets":{'), red, F.lit('"B08":{"href":"n"},"SCL":{"href":"s"}},"properties":{"datetime":"'), at, F.lit('","eo:cloud_cover":'), cloud, crs, F.lit("}}"))
    rows = stac_items.granules(_t(spark, d, "events").select(item.alias("item")))
    return rows.select("item_id", "collection", "cloud_cover_pct", "epsg", "problem")


@query("SELECT o_orderkey, epoch_ms(o_orderdate) AS t, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice * 0.25::DOUBLE, 4) END AS low FROM orders")
def chart_points(spark, d):
    p25 = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") * 0.25)
    rows = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("observed_at"), p25.alias("p25"), F.col("o_totalprice").alias("p75"))
    return views.chart_points(rows).select("o_orderkey", "t", "date", F.round(F.col("band")[0], 4).alias("low"))


@query("""WITH a AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'grid' WHEN event_id % 7 = 0 THEN '' WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS sig, event_id FROM events),
f AS (SELECT user_id, sig, min(event_id) AS first FROM a WHERE sig <> '' GROUP BY 1, 2), g AS (SELECT user_id, string_agg(sig, ',' ORDER BY first) AS signatures, count(*) > 1 AS mismatch FROM f GROUP BY 1)
SELECT u.user_id, coalesce(signatures, '') AS signatures, coalesce(mismatch, false) AS mismatch FROM (SELECT DISTINCT user_id FROM a) u LEFT JOIN g USING (user_id)""")
def grid_mismatch(spark, d):
    k = F.col("event_id")
    sig = F.when(F.col("user_id") % 3 == 0, "grid").when(k % 7 == 0, "").when(k % 5 != 0, F.col("event_type"))
    rows = views.grid_mismatch(_t(spark, d, "events").select("user_id", "event_id", sig.alias("sig")), "user_id", "sig", "event_id")
    return rows.withColumn("signatures", F.array_join("signatures", ","))


@query(_POINTS + """, b AS (SELECT *, lat - 2.5::DOUBLE / 110.57 AS s, lat + 2.5::DOUBLE / 110.57 AS n FROM p), h AS (SELECT *, 5.0::DOUBLE / (111.32 * cos(radians((s + n) / 2))) AS half FROM b)
SELECT c_custkey, round(greatest(lon - half, -180), 6) AS w, round(s, 6) AS s, round(least(lon + half, 180), 6) AS e, round(n, 6) AS n,
round(abs(least(lon + half, 180) - greatest(lon - half, -180)) * 111.32 * cos(radians((s + n) / 2)) * abs(n - s) * 110.57, 4) AS area_km2 FROM h""")
def default_bbox(spark, d):
    box = views.bbox_around(F.col("lon"), F.col("lat"), F.lit(10.0), F.lit(5.0))
    made = _points(spark, d).select("c_custkey", *[c.alias(k) for c, k in zip(box, "wsen")])
    area = views.plate_area_km2(*[F.col(k) for k in "wsen"])
    return made.select("c_custkey", *[F.round(k, 6).alias(k) for k in "wsen"], F.round(area, 4).alias("area_km2"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE) THEN month(CAST(o_orderdate AS DATE) + CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) // 2 AS INT)) END AS month, CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) > 60 AS suggest FROM lineitem JOIN orders ON l_orderkey = o_orderkey".replace("CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) > 60", "date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 60"))
def seasonal_advice(spark, d):
    j = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", views.midpoint_month(a, b).cast("long").alias("month"), views.suggest_seasonal(F.datediff(b, a), F.lit("temporal"), 60).alias("suggest"))


_REASON_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in views.REASONS.items())
_CODES = [*views.REASONS, "outside_seasonal_window", ""]


@query(f"WITH m(code, label) AS (VALUES {_REASON_ROWS}), c AS (SELECT o_orderkey, [{', '.join(repr(c) for c in _CODES)}][o_orderkey % {len(_CODES)} + 1] AS code FROM orders) SELECT o_orderkey, CASE WHEN code <> '' THEN coalesce(label, replace(code, '_', ' ')) END AS label FROM c LEFT JOIN m USING (code)")
def exclusion_labels(spark, d):
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("o_orderkey") % len(_CODES) + 1).cast("int"))
    return _t(spark, d, "orders").select("o_orderkey", views.reason_label(code).alias("label"))


@query("SELECT o_orderkey, '{\"customer\":' || o_custkey || ',\"priority\":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '\"' || o_orderpriority || '\"' END || ',\"status\":\"' || o_orderstatus || '\"}' AS document FROM orders")
def summary_documents(spark, d):
    priority = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    return _t(spark, d, "orders").select("o_orderkey", documents.document(status=F.col("o_orderstatus"), customer=F.col("o_custkey"), priority=priority).alias("document"))


def ndvi_previews(spark, d):
    """PNG bytes of each acquisition's coloured index, by digest; the tests decode them."""
    indexed = raster.index_pixels(pixels(spark, d))
    table = F.broadcast(views.colour_table(spark))  # 256 rows
    shown = indexed.withColumn("i", raster.colour_index(F.col("ndvi"))).join(table, "i", "left")
    missing = F.col("in_aoi") & ~F.col("covered")
    colour = [F.when(missing, views.MISSING_RGBA[k]).otherwise(F.coalesce(c, F.lit(0))).cast("int").alias(c) for k, c in enumerate("rgb")]
    shown = shown.select("acquisition", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *colour, F.when(missing | F.col("ndvi").isNotNull(), 255).otherwise(0).alias("alpha"))
    return images.png_images(shown).select("acquisition", F.length("content").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def ndvi_rasters(spark, d):
    """GeoTIFF bytes of each acquisition's index, by digest; the tests read them back."""
    p = raster.index_pixels(pixels(spark, d)).select("acquisition", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "ndvi")
    return images.geotiff_rasters(p, 8, 8, 300000.0, 4700000.0, 10.0, 32617).select("acquisition", F.length("content").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


QUERIES["ndvi_previews"], QUERIES["ndvi_rasters"] = ndvi_previews, ndvi_rasters


# -- records of events as JSON, some of them broken, against a schema --------------------------------------
_RECORD = {
    "type": "object", "required": ["id", "kind", "value"], "additionalProperties": False,
    "properties": {"id": {"type": "integer", "minimum": 0}, "kind": {"enum": ["click", "view", "purchase", "error", "signup"]}, "value": {"type": "number", "maximum": 80}, "tags": {"type": "array", "maxItems": 2, "items": {"type": "string", "pattern": "^t[0-9]$"}}},
}


@query("""SELECT event_id, CASE WHEN event_id % 17 = 3 THEN '$: not json' ELSE array_to_string(list_filter([
  CASE WHEN event_id % 5 = 0 THEN '$.kind: required' END, CASE WHEN event_id % 5 <> 0 AND event_type NOT IN ('click', 'view', 'purchase', 'error', 'signup') THEN '$.kind: enum' END,
  CASE WHEN event_id % 7 = 1 THEN '$.value: type' WHEN value > 80 THEN '$.value: maximum' END, CASE WHEN event_id % 4 = 3 THEN '$.tags: maxItems' END, CASE WHEN event_id % 6 = 2 THEN '$.tags[0]: pattern' END,
  CASE WHEN event_id % 11 = 4 THEN '$.more: not allowed' END], lambda x: x IS NOT NULL), ', ') END AS breaches FROM events""")
def record_breaches(spark, d):
    k = F.col("event_id")
    tags = F.concat(F.lit('["'), F.when(k % 6 == 2, "x").otherwise("t"), F.lit('1"'), F.when(k % 4 == 3, F.lit(',"t2","t3"')).otherwise(F.lit("")), F.lit("]"))
    fields = [
        F.concat(F.lit('"id":'), k.cast("string")), F.when(k % 5 != 0, F.concat(F.lit('"kind":"'), "event_type", F.lit('"'))), F.concat(F.lit('"value":'), F.when(k % 7 == 1, F.lit('"much"')).otherwise(F.col("value").cast("string"))),
        F.concat(F.lit('"tags":'), tags), F.when(k % 11 == 4, F.lit('"more":null')),
    ]
    text = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.when(k % 17 == 3, F.lit("")).otherwise(F.lit("}")))
    return _t(spark, d, "events").select("event_id", F.array_join(json_schema.problems(text, _RECORD), ", ").alias("breaches"))
