"""Queries over what the engine stores: the catalogue's data source and the tile table, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from verdara.plans.queries import _t, query
from verdara.session import scratch_path, ship
from verdara.sources import catalog_source, tiles


# -- the catalogue: an item for each event -----------------------------------------------------------------
def catalog_items(spark, d):
    k = F.col("event_id")
    west, south = (k * 7919 % 3400).cast("double") / 10 - 175, (k * 104729 % 1500).cast("double") / 10 - 75
    box = dict(zip(catalog_source.SIDES, (west, south, west + 1.5, south + 1.0), strict=True))
    cloud = F.get_json_object("props", "$.k").cast("double")
    return _t(spark, d, "events").select(F.format_string("E%07d", k).alias("item_id"), F.col("event_type").alias("collection"), F.col("ts").cast("timestamp").alias("ts"), cloud.alias("cloud"), *[v.alias(n) for n, v in box.items()], F.col("props").alias("item"))


@query("""WITH i AS (SELECT printf('E%07d', event_id) AS item_id, event_type AS collection, ts, CAST(json_extract(props, '$.k') AS DOUBLE) AS cloud, CAST(event_id * 7919 % 3400 AS DOUBLE) / 10 - 175 AS west, CAST(event_id * 104729 % 1500 AS DOUBLE) / 10 - 75 AS south FROM events)
SELECT item_id, collection, cloud, round(west, 6) AS west, round(south, 6) AS south FROM i WHERE collection = 'view' AND cloud < 60 AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-20' AND west <= 40 AND west + 1.5 >= -60 AND south <= 50 AND south + 1.0 >= -20""")
def catalog_scan(spark, d):
    ship(spark)
    path = scratch_path(spark, "catalog")
    catalog_source.write_snapshot(catalog_items(spark, d), path, days=5)
    found = catalog_source.scan(spark, path=path).where((F.col("collection") == "view") & (F.col("cloud") < 60) & (F.col("ts") >= datetime(2024, 1, 8)) & (F.col("ts") < datetime(2024, 1, 20)))
    return found.where(catalog_source.in_box(-60.0, -20.0, 40.0, 50.0)).select("item_id", "collection", "cloud", F.round("west", 6).alias("west"), F.round("south", 6).alias("south"))


# -- tiles: a raster for each line number, a pixel for each order ----------------------------------------
def line_pixels(spark, d):
    k = F.col("l_orderkey")
    cells = _t(spark, d, "lineitem").select(F.col("l_linenumber").alias("item_id"), F.floor(k / 128).cast("int").alias("row"), (k % 128).cast("int").alias("col"), "l_quantity", "l_extendedprice")
    return cells.selectExpr("item_id", "row", "col", "stack(2, 'quantity', l_quantity, 'price', l_extendedprice) as (band, value)")


@query("""SELECT l_linenumber AS item_id, band, CAST(l_orderkey // 128 AS INT) AS row, CAST(l_orderkey % 128 AS INT) AS col, max(value) AS value
FROM (SELECT l_linenumber, l_orderkey, unnest(['quantity', 'price']) AS band, unnest([l_quantity, l_extendedprice]) AS value FROM lineitem) WHERE l_orderkey // 128 BETWEEN 20 AND 51 AND l_orderkey % 128 BETWEEN 33 AND 69 GROUP BY 1, 2, 3, 4""")
def tile_window(spark, d):
    path = scratch_path(spark, "tiles")
    tiles.write(line_pixels(spark, d), path, size=8, tiles_per_group=64)
    return tiles.window(tiles.read(spark, path), (20, 52), (33, 70), size=8)
