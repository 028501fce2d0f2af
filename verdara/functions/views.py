"""What a reader of results is shown: chart points, labels, legends, advice. Columns and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The display's colour stops, colours, labels and kilometres a degree.
STOPS = (
    (0.00, (120, 69, 25)), (0.20, (179, 116, 44)), (0.40, (226, 190, 100)), (0.55, (247, 237, 138)),
    (0.70, (173, 204, 92)), (0.85, (90, 160, 56)), (1.00, (16, 105, 34)),
)
MISSING_RGBA = (104, 106, 114, 255)
REASONS = {
    "cloud_cover_above_threshold": "Cloud cover above the configured threshold",
    "not_selected_temporal_sampling": "Not selected by temporal sampling within the scene limit",
    "insufficient_valid_pixels": "Too few valid (unmasked) pixels for reliable statistics",
    "all_pixels_masked": "All pixels were masked as cloud, shadow, or snow",
    "no_raster_overlap_with_aoi": "The source imagery did not overlap the area of interest",
    "insufficient_aoi_coverage": "Source granules did not cover enough of the area of interest",
}
KM_LON, KM_LAT = 111.32, 110.57


def colour_table(spark: SparkSession) -> DataFrame:
    """i, r, g, b of 256 colours, between the stops linearly and cut to whole numbers."""
    at = F.col("id") / F.lit(255.0)

    def channel(k: int) -> Column:
        out = F.lit(float(STOPS[-1][1][k]))
        for (p, c), (q, d) in reversed(list(zip(STOPS, STOPS[1:]))):
            out = F.when(at < q, (at - p) * ((d[k] - c[k]) / (q - p)) + float(c[k])).otherwise(out)
        return out.cast("int")

    return spark.range(256).select(F.col("id").cast("int").alias("i"), *[channel(k).alias(c) for k, c in enumerate("rgb")])


def legend(spark: SparkSession, low: float, high: float) -> DataFrame:
    """position, value, colour of each stop."""
    rows = [(p, "#" + "".join(f"{x:02x}" for x in c)) for p, c in STOPS]
    return spark.createDataFrame(rows, "position double, colour string").withColumn("value", F.round(low + F.col("position") * (high - low), 3))


def reason_label(code: Column, coverage_pct: Column | None = None) -> Column:
    """Words for an exclusion code: its label, else the code with spaces; NULL for no code."""
    table = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    out = F.coalesce(table[code], F.replace(code, F.lit("_"), F.lit(" ")))
    if coverage_pct is not None:
        share = F.concat(F.lit("Source granules covered only "), F.format_number(coverage_pct, 1), F.lit("% of the area of interest"))
        out = F.when((code == "insufficient_aoi_coverage") & coverage_pct.isNotNull(), share).otherwise(out)
    return F.when(code != "", out)


def chart_points(rows: DataFrame) -> DataFrame:
    """Adds t (epoch ms), date and band, the quartiles when both are there."""
    ts = F.col("observed_at").cast("timestamp")
    both = F.col("p25").isNotNull() & F.col("p75").isNotNull()
    return rows.withColumns({"t": F.unix_millis(ts), "date": F.date_format(ts, "yyyy-MM-dd"), "band": F.when(both, F.array("p25", "p75"))})


def grid_mismatch(artifacts: DataFrame, key: str, signature: str, order: str) -> DataFrame:
    """A row for each key: distinct signatures as first seen, and whether they are more than one."""
    seen = artifacts.where(F.col(signature) != "").groupBy(key, signature).agg(F.min(order).alias("first"))
    listed = seen.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", signature))).alias("s"))
    listed = listed.select(key, F.col("s")[signature].alias("signatures"), (F.size("s") > 1).alias("mismatch"))
    out = artifacts.select(key).distinct().join(listed, key, "left")
    return out.select(key, F.coalesce("signatures", F.array().cast("array<string>")).alias("signatures"), F.coalesce("mismatch", F.lit(False)).alias("mismatch"))


def plate_area_km2(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Quick estimate of a bbox's area, by kilometres a degree at its middle latitude."""
    return F.abs(e - w) * KM_LON * F.cos(F.radians((s + n) / 2)) * F.abs(n - s) * KM_LAT


def bbox_around(lon: Column, lat: Column, width_km: Column, height_km: Column) -> tuple[Column, Column, Column, Column]:
    """The bbox of that size about a point, kept within the globe."""
    clamp = lambda v, low, high: F.least(F.greatest(v, F.lit(low)), F.lit(high))
    s, n = clamp(lat - height_km / 2 / KM_LAT, -90.0, 90.0), clamp(lat + height_km / 2 / KM_LAT, -90.0, 90.0)
    km = KM_LON * F.cos(F.radians((s + n) / 2))
    half = F.when(km > 1e-6, clamp(width_km / 2 / F.nullif(km, F.lit(0.0)), 0.0, 180.0)).otherwise(180.0)
    return clamp(lon - half, -180.0, 180.0), s, clamp(lon + half, -180.0, 180.0), n


def normal_bbox(w: Column, s: Column, e: Column, n: Column) -> tuple[Column, Column, Column, Column]:
    return F.least(w, e), F.least(s, n), F.greatest(w, e), F.greatest(s, n)


def midpoint_month(start: Column, end: Column) -> Column:
    """Month of the day midway, the earlier of two; NULL for a reversed range."""
    return F.when(end >= start, F.month(F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))))


def suggest_seasonal(span_days: Column, strategy: Column, above: int = 400) -> Column:
    return F.coalesce((strategy == "temporal") & (span_days > above), F.lit(False))


def describe_strategy(strategy: Column, month: Column) -> Column:
    """Words for how observations were chosen, with the target month of a seasonal choice."""
    name = F.when(strategy == "seasonal", "Same season each year").when(strategy == "temporal", "Spread across the range").otherwise(strategy)
    target = F.when((strategy == "seasonal") & month.between(1, 12), F.concat(F.lit(" (target: "), F.date_format(F.make_date(F.lit(2024), month, F.lit(1)), "MMMM"), F.lit(")")))
    return F.concat(name, F.coalesce(target, F.lit("")))


def overlay_xy(lon: Column, lat: Column, box: tuple[Column, ...], width: int, height: int) -> tuple[Column, Column]:
    """Pixel of a point on an image that spans the bbox, y downwards."""
    w, s, e, n = box
    return (lon - w) / (e - w) * width, (n - lat) / (n - s) * height
