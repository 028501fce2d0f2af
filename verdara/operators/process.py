"""All selected acquisitions at once: mosaic, scaling, mask, index, coverage, statistics and gates in one plan.

The pixels of all granules are shuffled by acquisition and cell for the mosaic, what tasks make of them by acquisition for the
statistics; acquisitions and cells of the grid are joined beside them, broadcast where they are small. An item is
its place among its acquisition's, a number, so that mosaics are hashed. Nothing loops over acquisitions, and no task
holds an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdara.operators import raster

BANDS = ("red", "nir", "scl")
# How the mosaic is made, as results say it.
MOSAIC = {"mosaic_method": "first-valid-by-item-id", "resampling_spectral": "bilinear", "resampling_categorical": "nearest", "window_pad_px": 4}


def mosaic_bands(granules: DataFrame, key: str = "acquisition", *more: Column) -> DataFrame:
    """(key, row, col, red, nir, scl, red_rank, nir_rank, scl_rank, covered) from rows (key, row, col, rank, band, value, covered).

    Each band takes the value of the least rank, which says whose it is; a cell is covered when some item covers it in every
    band. `more`: other aggregates. All state is numbers, so cells are hashed and never sorted.
    """
    order = lambda b: F.when((F.col("band") == b) & F.col("value").isNotNull(), F.col("rank"))
    first = [c for b in BANDS for c in (F.min_by("value", order(b)).alias(b), F.min(order(b)).alias(f"{b}_rank"))]
    seen = [F.bool_or((F.col("band") == b) & F.col("covered") & F.col("rank").isNotNull()).alias(f"{b}_covered") for b in BANDS]
    by = granules.groupBy(key, "row", "col").agg(*first, *seen, *more)
    covered = F.coalesce(F.col("red_covered") & F.col("nir_covered") & F.col("scl_covered"), F.lit(False))
    return by.withColumn("covered", covered).drop(*[f"{b}_covered" for b in BANDS])


def process_acquisitions(acquisitions: DataFrame, granules: DataFrame, cells: DataFrame, key: str = "acquisition", min_coverage: float = 99.0, min_valid: float = 10.0, masked: tuple[int, ...] = raster.MASKED) -> DataFrame:
    """One row an acquisition: statistics, coverage, scaling, contributors, warnings, usable and reason.

    acquisitions: (key, dominant_baseline, item_ids); granules: (key, row, col, item_id, band, value, covered) in sensor
    numbers, those of other items are left out; cells: (row, col, in_aoi) of the one grid. An acquisition without a pixel has no overlap, and no statistics.
    """
    scaled = acquisitions.withColumns({"scaling": raster.band_scaling(F.col("dominant_baseline")), "_items": F.array_sort(F.array_distinct("item_ids"))})
    own = scaled.select(key, "_items", F.col("scaling.scale").alias("scale"), F.col("scaling.offset").alias("offset"))
    rank = F.nullif(F.array_position(F.col("_items"), F.col("item_id")), F.lit(0))
    placed = granules.join(own, key).select(key, "row", "col", "band", "value", "covered", rank.alias("rank"), "scale", "offset")
    pixels = mosaic_bands(placed, key, F.first("scale").alias("scale"), F.first("offset").alias("offset"))
    pixels = pixels.join(cells.select("row", "col", "in_aoi"), ["row", "col"])
    scale, offset, ok = F.col("scale"), F.col("offset"), raster.scl_valid(F.col("scl"), masked)
    pixels = pixels.withColumns({b: raster.reflectance(F.col(b), scale, offset) for b in ("red", "nir")}).withColumn("valid_mask", ok)
    red, nir = F.col("red"), F.col("nir")
    pixels = pixels.withColumns({"ndvi": F.when(F.col("valid_mask") & F.col("in_aoi"), raster.ndvi(red, nir)), "zero_den": F.col("valid_mask") & raster.zero_denominator(red, nir)})
    # The class looks at the index inside the area only, and only counts there.
    pixels = pixels.withColumn("class", raster.coverage_class(F.col("covered"), red, nir, F.col("scl"), F.col("ndvi"), masked))
    used = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.collect_set(f"{b}_rank") for b in BANDS])))).alias("used")
    stats = raster.gate(raster.scene_summary(pixels, used, key=key), min_coverage, min_valid)
    out = scaled.join(stats, key, "left")
    none = F.coalesce(F.col("covered_px"), F.lit(0)) == 0
    told = F.when(none, "no_raster_overlap_with_aoi").otherwise(F.col("reason"))
    short = F.when(told == "insufficient_aoi_coverage", F.concat(F.lit("coverage of "), F.format_number("coverage_pct", 2), F.lit(f" % is below {min_coverage:g} %")))
    numbers = [c for c in stats.columns if c not in (key, "used", "reason", "usable")]
    return out.select(
        *acquisitions.columns, "scaling", *[F.when(~none, F.col(c)).alias(c) for c in numbers], told.isNull().alias("usable"), told.alias("reason"),
        F.when(F.size("used") > 0, F.transform("used", lambda k: F.element_at("_items", k.cast("int")))).otherwise(F.col("item_ids")).alias("contributing_item_ids"), F.array_compact(F.array(short)).alias("process_warnings"),
    )


def empty_statistics(aoi_px: Column) -> Column:
    """The statistics of an acquisition without a valid pixel."""
    none = F.lit(None).cast("double")
    names = ("ndvi_min", "ndvi_max", "ndvi_mean", "ndvi_median", "ndvi_std", "ndvi_p10", "ndvi_p25", "ndvi_p75", "ndvi_p90")
    return F.struct(F.lit(0).cast("long").alias("valid_px"), aoi_px.alias("masked_px"), aoi_px.alias("aoi_px"), F.lit(0.0).alias("valid_pixel_pct"), F.lit(0).cast("long").alias("zero_den_px"), *[none.alias(n) for n in names])


class AnalysisFailed(Exception):
    """An analysis that can't give a result. `category` says whose matter it is."""

    category = "internal"


class UserInput(AnalysisFailed):
    category = "user_input"


class NoUsableData(AnalysisFailed):
    category = "data"


class Transient(AnalysisFailed):
    """To be tried again; nothing is recorded as failed."""

    category = "transient"


def failure_category(error: BaseException) -> str:
    return getattr(error, "category", "timeout" if isinstance(error, TimeoutError) else "internal")


def require_usable(results: DataFrame) -> DataFrame:
    """`results`, or NoUsableData with the sorted reasons if none is usable, or more than one grid among usable ones."""
    grids = F.count_distinct(F.when(F.col("usable"), F.col("grid"))) if "grid" in results.columns else F.lit(0)
    row = results.agg(F.count_if("usable").alias("n"), F.array_sort(F.collect_set("reason")).alias("reasons"), grids.alias("grids")).first()
    if not row["n"]:
        raise NoUsableData("no usable acquisition: " + (", ".join(row["reasons"]) or "no candidates"))
    if row["grids"] > 1:
        raise AnalysisFailed(f"{row['grids']} grids among usable acquisitions")
    return results
