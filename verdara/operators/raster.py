"""Pixel operators: scaling, masking, NDVI, coverage classes, statistics, mosaics, previews.

A pixel table has one row a grid cell and acquisition; missing values are NULL, never NaN. Every operator is
a Catalyst expression or one aggregate, so a plan over all acquisitions shuffles once, by acquisition. Aggregates hash but for
mosaics of items whose ids are texts, and percentiles gather a group's values (`scene_stats_refined` doesn't).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from verdara.operators import percentiles

# Scene classes by meaning, and the default mask policy.
CLOUD, SNOW, NODATA = (3, 8, 9, 10), 11, 0
MASKED = (0, 1, 3, 8, 9, 10, 11)
OFFSET_BASELINE, OFFSET, SCALE = 4.0, -0.1, 1e-4


def scl_valid(scl: Column, masked: tuple[int, ...] = MASKED) -> Column:
    known = scl.isNotNull()
    return known & ~scl.isin(*masked) if masked else known


def band_scaling(baseline: Column, ext_scale: Column | None = None, ext_offset: Column | None = None) -> Column:
    """struct(scale, offset, source): raster extension, then the processing baseline, then the default."""
    number = baseline.try_cast("double")
    made = lambda offset, source: F.struct(F.lit(SCALE).alias("scale"), F.lit(offset).alias("offset"), F.lit(source).alias("source"))
    out = F.when(number >= OFFSET_BASELINE, made(OFFSET, "baseline_heuristic")).when(number < OFFSET_BASELINE, made(0.0, "baseline_heuristic")).otherwise(made(OFFSET, "default"))
    if ext_scale is not None and ext_offset is not None:
        own = F.struct(ext_scale.alias("scale"), ext_offset.alias("offset"), F.lit("raster_ext").alias("source"))
        out = F.when(ext_scale.isNotNull() & ext_offset.isNotNull(), own).otherwise(out)
    return out


def reflectance(dn: Column, scale: float | Column = SCALE, offset: float | Column = OFFSET) -> Column:
    return dn.cast("double") * scale + offset


def _clip(band: Column) -> Column:
    return F.when(band < 0, F.lit(0.0)).otherwise(band)  # greatest() would turn NULL into 0


def ndvi(red: Column, nir: Column) -> Column:
    """Float index of two reflectances; NULL when a band is NULL or both are 0."""
    r, n = _clip(red), _clip(nir)
    return F.try_divide(n - r, F.nullif(n + r, F.lit(0.0))).cast("float")


def zero_denominator(red: Column, nir: Column) -> Column:
    return F.coalesce(_clip(red) + _clip(nir) == 0, F.lit(False))


def coverage_class(covered: Column, red: Column, nir: Column, scl: Column, index: Column, masked: tuple[int, ...] = MASKED) -> Column:
    """One class a pixel, by precedence: uncovered, nodata, cloud, snow, other mask, invalid, valid."""
    policy = lambda *c: scl.isin(*[x for x in c if x in masked]) if any(x in masked for x in c) else F.lit(False)
    rest = [c for c in masked if c not in (*CLOUD, SNOW, NODATA)]
    return (
        F.when(~covered, "uncovered")
        .when(scl.isNull() | (scl == NODATA) | red.isNull() | nir.isNull(), "nodata")
        .when(policy(*CLOUD), "cloud")
        .when(policy(SNOW), "snow")
        .when(policy(*rest), "other_masked")
        .when(index.isNull(), "invalid_spectral")
        .otherwise("valid")
    )


def index_pixels(pixels: DataFrame, scale: float = SCALE, offset: float = OFFSET, masked: tuple[int, ...] = MASKED) -> DataFrame:
    """Adds red, nir (reflectance), valid_mask, ndvi, zero_den, class to (red_dn, nir_dn, scl, covered)."""
    out = pixels.withColumns({"red": reflectance(F.col("red_dn"), scale, offset), "nir": reflectance(F.col("nir_dn"), scale, offset), "valid_mask": scl_valid(F.col("scl"), masked)})
    red, nir, ok = F.col("red"), F.col("nir"), F.col("valid_mask")
    out = out.withColumns({"ndvi": F.when(ok, ndvi(red, nir)), "zero_den": ok & zero_denominator(red, nir)})
    return out.withColumn("class", coverage_class(F.col("covered"), red, nir, F.col("scl"), F.col("ndvi"), masked))


CLASSES = ("uncovered", "nodata", "cloud", "snow", "other_masked", "invalid_spectral", "valid")


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(100.0 * part / F.nullif(whole, F.lit(0)), 4))


def _coverage_counts() -> list[Column]:
    aoi = F.col("in_aoi")
    return [F.count_if(aoi & F.col("covered")).alias("covered_px"), *[F.count_if(aoi & (F.col("class") == c)).alias(f"{c}_px") for c in CLASSES], F.count_if("zero_den").alias("zero_den_px")]


def _statistics() -> list[Column]:
    """Of valid AOI pixels; all NULL without one. The float index is widened before it is averaged; one pass over
    a group's values gives all five percentiles."""
    v = F.when(F.col("in_aoi"), F.col("ndvi").cast("double"))
    shares = F.percentile(v, F.array(*[F.lit(p) for p in (0.5, 0.1, 0.25, 0.75, 0.9)]))
    return [F.count(v).alias("valid_px"), F.min(v).alias("ndvi_min"), F.max(v).alias("ndvi_max"), F.avg(v).alias("ndvi_mean"), F.stddev_pop(v).alias("ndvi_std"), shares.alias("_shares")]


def _with_percentiles(stats: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 6)
    out = stats.withColumns({f"ndvi_{n}": r(F.col("_shares")[k]) for k, n in enumerate(("median", "p10", "p25", "p75", "p90"))}).drop("_shares")
    out = out.withColumns({n: r(F.col(n)) for n in ("ndvi_min", "ndvi_max", "ndvi_mean", "ndvi_std")})
    return out.withColumns({"masked_px": F.col("aoi_px") - F.col("valid_px"), "valid_pixel_pct": _pct(F.col("valid_px"), F.col("aoi_px"))})


def _with_shares(stats: DataFrame) -> DataFrame:
    return stats.withColumns({"coverage_pct": _pct(F.col("covered_px"), F.col("aoi_px")), "cloud_pct": _pct(F.col("cloud_px"), F.col("aoi_px"))})


def coverage_stats(indexed: DataFrame, key: str = "acquisition") -> DataFrame:
    """Counts of the AOI's classes by acquisition; zero denominators are counted over the whole grid."""
    return _with_shares(indexed.groupBy(key).agg(F.count_if("in_aoi").alias("aoi_px"), *_coverage_counts()))


def scene_stats(indexed: DataFrame, key: str = "acquisition") -> DataFrame:
    """Statistics of valid AOI pixels by acquisition."""
    return _with_percentiles(indexed.groupBy(key).agg(F.count_if("in_aoi").alias("aoi_px"), *_statistics()))


def scene_stats_refined(indexed: DataFrame, key: str = "acquisition") -> DataFrame:
    """`scene_stats` for groups of any size: percentiles by refinement, none of whose passes holds a group's values."""
    *plain, _ = _statistics()
    stats = indexed.groupBy(key).agg(F.count_if("in_aoi").alias("aoi_px"), *plain)
    shares = percentiles.exact(indexed, key, F.when(F.col("in_aoi"), F.col("ndvi")), [0.5, 0.1, 0.25, 0.75, 0.9])
    shares = shares.select(F.col(key).alias("_key"), F.col("shares").alias("_shares"))
    return _with_percentiles(stats.join(shares, stats[key].eqNullSafe(shares["_key"]), "left").drop("_key"))


def scene_summary(indexed: DataFrame, *more: Column, key: str = "acquisition") -> DataFrame:
    """Statistics and coverage in one aggregate: the pixels are read and shuffled once. `more`: other aggregates."""
    counts = [c for c in _coverage_counts() if c is not None]
    out = indexed.groupBy(key).agg(F.count_if("in_aoi").alias("aoi_px"), *_statistics(), *[c.alias("valid_class_px") if k == 1 + CLASSES.index("valid") else c for k, c in enumerate(counts)], *more)
    out = _with_shares(_with_percentiles(out))
    share = lambda c: _pct(F.col(c), F.col("aoi_px"))
    return out.withColumns({"valid_coverage_pct": share("valid_class_px"), "missing_data_pct": _pct(F.col("uncovered_px") + F.col("nodata_px"), F.col("aoi_px"))})


def gate(stats: DataFrame, min_coverage: float = 99.0, min_valid: float = 10.0) -> DataFrame:
    """Adds usable and reason; the coverage gate comes before those of validity."""
    reason = (
        F.when(F.col("covered_px") == 0, "no_raster_overlap_with_aoi")
        .when(100.0 * F.col("covered_px") / F.col("aoi_px") < min_coverage, "insufficient_aoi_coverage")
        .when(F.col("valid_px") == 0, "all_pixels_masked")
        .when(F.col("valid_pixel_pct") < min_valid, "insufficient_valid_pixels")
    )
    return stats.withColumn("reason", reason).withColumn("usable", F.col("reason").isNull())


def _first(granules: DataFrame, item: str, value: str, *only: Column) -> tuple[Column, Column]:
    """(value, item) of the least item that has a value. Numbers are hashed; of ids that are texts the cells are sorted,
    so rank them first (`process_acquisitions` does) where there are many."""
    some = F.col(value).isNotNull()
    for condition in only:
        some &= condition
    if isinstance(granules.schema[item].dataType, IntegralType):
        order = F.when(some, F.col(item))
        return F.min_by(value, order), F.min(order)
    winner = F.min(F.when(some, F.struct(F.col(item).alias("item"), F.col(value).alias("value"))))
    return winner["value"], winner["item"]


def mosaic_first_valid(granules: DataFrame, cell: list[str], item: str = "item_id", value: str = "value") -> DataFrame:
    """First valid value of each cell by ascending item, its item, the number of items, and whether any item covers
    the cell, if the table says so for each."""
    first, winner = _first(granules, item, value)
    own = [F.bool_or("covered").alias("covered")] if "covered" in granules.columns else []
    return granules.groupBy(*cell).agg(first.alias("value"), winner.alias("winner"), F.count(F.lit(1)).alias("n_items"), *own)


def colour_index(v: Column, low: float = -0.2, high: float = 0.9) -> Column:
    """Place in a 256-colour table."""
    part = (v.cast("double") - low) / (high - low)
    return (F.when(part < 0, 0.0).when(part > 1, 1.0).otherwise(part) * 255).cast("int")


def decimate(pixels: DataFrame, longest: int, max_dim: int) -> DataFrame:
    step = max(1, -(-longest // max_dim))
    return pixels.where((F.col("row") % step == 0) & (F.col("col") % step == 0))


def true_colour(pixels: DataFrame, longest: int, max_dim: int = 1024) -> DataFrame:
    """(row, col, r, g, b, alpha) and the key's columns of a preview from `mosaic_rgb`'s red, green, blue by row and col:
    every step-th cell, renumbered; transparent where a column `valid` says no."""
    step = max(1, -(-longest // max_dim))
    shown = F.when(F.coalesce("valid", F.lit(False)), 255).otherwise(0) if "valid" in pixels.columns else F.lit(255)
    place = [F.floor(F.col(c) / step).cast("int").alias(c) for c in ("row", "col")]
    key = [c for c in pixels.columns if c not in ("row", "col", "red", "green", "blue", "valid")]
    return decimate(pixels, longest, max_dim).select(*key, *place, F.col("red").alias("r"), F.col("green").alias("g"), F.col("blue").alias("b"), shown.alias("alpha"))


def resample_nearest(cells: DataFrame, source: DataFrame, resolution: float, left: float, top: float) -> DataFrame:
    """cells (row, col, x, y of the centre) with the value of the source cell that holds the centre.

    source: key, row, col, value on the lattice that starts at (left, top). One equi-join on the source cell,
    so both sides shuffle by it at most once; cells that no source cell holds have no rows.
    """
    at = cells.withColumns({"_c": F.floor((F.col("x") - left) / resolution), "_r": F.floor((top - F.col("y")) / resolution)})
    src = source.select("key", F.col("row").alias("_sr"), F.col("col").alias("_sc"), "value")
    return at.join(src, (F.col("_r") == F.col("_sr")) & (F.col("_c") == F.col("_sc"))).select("key", "row", "col", "value")


def resample_bilinear(cells: DataFrame, source: DataFrame, resolution: float, left: float, top: float) -> DataFrame:
    """As resample_nearest, with the mean of the four cells about the centre by their distance; missing ones have no weight."""
    at = cells.withColumns({"_u": (F.col("x") - left) / resolution - 0.5, "_v": (top - F.col("y")) / resolution - 0.5})
    at = at.withColumns({"_c": F.floor("_u"), "_r": F.floor("_v")})
    u, v = F.col("_u") - F.col("_c"), F.col("_v") - F.col("_r")
    near = [F.struct((F.col("_r") + i).alias("r"), (F.col("_c") + j).alias("c"), ((v if i else 1 - v) * (u if j else 1 - u)).alias("w")) for i in (0, 1) for j in (0, 1)]
    at = at.select("row", "col", F.explode(F.array(*near)).alias("n")).where("n.w > 0").select("row", "col", "n.*")
    src = source.select("key", F.col("row").alias("r"), F.col("col").alias("c"), "value").where("value is not null")
    part = at.join(src, ["r", "c"]).groupBy("key", "row", "col").agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.sum("w").alias("w"))
    return part.select("key", "row", "col", (F.col("s") / F.col("w")).alias("value"))


def mosaic_rgb(granules: DataFrame, cell: list[str], bands: tuple[str, str, str] = ("red", "green", "blue")) -> DataFrame:
    """First valid value of each band by ascending item, as 0 to 255; 0 where a band has none. One shuffle."""

    def band(name: str) -> Column:
        v = _first(granules, "item_id", "value", F.col("band") == name)[0]
        return F.least(F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)), F.lit(255.0)).cast("int").alias(name)

    return granules.groupBy(*cell).agg(*[band(b) for b in bands])
