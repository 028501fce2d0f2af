"""Granules to acquisitions: product ids, keys, grouping with weighted cloud and primary granule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the product id's format.
PRODUCT = r"^(S2[A-D])_(MSIL[12][ABC])_(\d{8}T\d{6})_(R\d{3})_(T\d\d[A-Z]{3})_(\d{8}T\d{6})$"


def product_part(product_id: Column, group: int) -> Column:
    """A part of a product id; NULL when the id isn't one."""
    return F.nullif(F.regexp_extract(product_id, PRODUCT, group), F.lit(""))


def acquisition_key(collection: Column, platform: Column, orbit: Column, ts: Column, unit: str = "minute") -> Column:
    """collection|platform|orbit|time truncated (not rounded) to the unit."""
    at = F.date_format(F.date_trunc(unit, ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.concat_ws("|", collection, F.lower(F.coalesce(platform, F.lit("unknown"))), F.coalesce(orbit, F.lit("Rxxx")), at)


def group_acquisitions(granules: DataFrame) -> DataFrame:
    """One row an acquisition from (key, item_id, ts, platform, cloud, overlap)."""
    overlap = F.coalesce(F.col("overlap"), F.lit(0.0))
    weight = F.when(F.col("cloud").isNotNull(), F.greatest(overlap, F.lit(1e-6)))
    return granules.groupBy("key").agg(
        F.count("*").alias("granule_count"),
        F.min("ts").alias("observed_at"),
        F.min_by("platform", "item_id").alias("platform"),
        F.max_by("item_id", F.struct(overlap, F.col("item_id"))).alias("primary_item"),
        F.round(F.try_divide(F.sum(F.col("cloud") * weight), F.sum(weight)), 6).alias("cloud"),
        F.array_join(F.array_sort(F.collect_set(F.col("item_id").cast("string"))), " ").alias("items"),
    )


def acquisition_records(granules: DataFrame) -> DataFrame:
    """One row an acquisition, whole, from granules (item_id, collection, observed_at, cloud_cover_pct, platform,
    processing_baseline, assets, aoi_overlap_pct, footprint: the rings of its outline).

    One aggregate by key; what follows is arithmetic on the row's granules in the order of their ids. The lowest
    baseline scales the acquisition.
    """
    key = acquisition_key(F.col("collection"), F.col("platform"), product_part(F.col("item_id"), 4), F.col("observed_at"))
    names = ["item_id", "collection", "observed_at", "cloud_cover_pct", "platform", "processing_baseline", "assets", "aoi_overlap_pct", "footprint"]
    by = granules.groupBy(key.alias("acquisition_key")).agg(F.array_sort(F.collect_list(F.struct(*names)), lambda a, b: F.when(a["item_id"] < b["item_id"], -1).when(a["item_id"] > b["item_id"], 1).otherwise(0)).alias("g"))
    each = lambda f: F.transform("g", f)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    overlap = lambda x: F.coalesce(x["aoi_overlap_pct"], F.lit(0.0))
    clouded = F.filter("g", lambda x: x["cloud_cover_pct"].isNotNull())
    weight = lambda x: F.greatest(overlap(x), F.lit(1e-6))
    baselines = F.array_sort(F.array_distinct(F.filter(each(lambda x: x["processing_baseline"]), lambda b: b != "")))
    tiles = F.array_sort(F.array_distinct(F.array_compact(each(lambda x: product_part(x["item_id"], 5)))))
    first = F.col("g")[0]
    out = by.select(
        "acquisition_key",
        F.array_max(each(lambda x: F.struct(overlap(x).alias("o"), x["item_id"].alias("i"))))["i"].alias("primary_item_id"),
        F.array_min(each(lambda x: x["observed_at"])).alias("observed_at"),
        (F.array_max(each(lambda x: F.unix_micros(x["observed_at"]))) - F.array_min(each(lambda x: F.unix_micros(x["observed_at"])))).alias("spread_us"),
        first["collection"].alias("collection"),
        first["platform"].alias("platform"),
        product_part(first["item_id"], 4).alias("relative_orbit"),
        F.try_divide(total(F.transform(clouded, lambda x: x["cloud_cover_pct"] * weight(x))), F.nullif(total(F.transform(clouded, weight)), F.lit(0.0))).alias("cloud_cover_pct"),
        each(lambda x: x["item_id"]).alias("item_ids"),
        tiles.alias("tile_ids"),
        baselines.alias("processing_baselines"),
        F.size("g").alias("granule_count"),
        F.map_from_arrays(F.array_distinct(each(lambda x: x["item_id"])), F.transform(F.array_distinct(each(lambda x: x["item_id"])), lambda i: F.filter("g", lambda x: x["item_id"] == i)[0]["assets"])).alias("assets"),
        F.flatten(each(lambda x: F.coalesce(x["footprint"], F.array().cast("array<array<struct<x:double,y:double>>>")))).alias("footprints"),
    )
    mixed = F.when(F.size("processing_baselines") > 1, F.concat(F.lit("processing baselines differ: "), F.array_join("processing_baselines", ", "), F.lit("; the lowest scales the acquisition")))
    several = F.when(F.col("granule_count") > 1, F.concat(F.lit("mosaic of "), F.col("granule_count").cast("string"), F.lit(" granules: "), F.array_join("tile_ids", ", ")))
    return out.withColumns({"dominant_baseline": F.get("processing_baselines", F.lit(0)), "warnings": F.array_compact(F.array(mixed, several))})
