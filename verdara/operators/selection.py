"""Deterministic selection of acquisitions: every row keeps its decision and reason in one table.

Windows without a partition rank decision rows (one an acquisition of one analysis, `analysis` else); with many
analyses in a table the windows are partitioned by analysis and spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cloud_key(cloud: Column) -> Column:
    return F.coalesce(cloud, F.lit(101.0))


def day_distance(at: Column, month: int, day: int) -> Column:
    """Days between a date and its year's target day, around the year's end; 29 February falls on the 28th else."""
    first = F.make_date(F.year(at), F.lit(month), F.lit(1))
    target = F.make_date(F.year(at), F.lit(month), F.least(F.lit(day), F.day(F.last_day(first))))
    length = F.datediff(F.make_date(F.year(at) + 1, F.lit(1), F.lit(1)), F.make_date(F.year(at), F.lit(1), F.lit(1)))
    x = F.abs(F.datediff(at, target))
    return F.least(x, length - x)


def gate_reason(max_cloud: float, min_coverage: float) -> Column:
    """Coverage before cloud; equality and unknown cloud pass."""
    return F.when(F.col("coverage") < min_coverage, "insufficient_aoi_coverage").when(F.col("cloud") > max_cloud, "cloud_cover_above_threshold")


def select_temporal(acqs: DataFrame, start: Column, end: Column, limit: int, max_cloud: float = 20.0, min_coverage: float = 99.0, by: str = "analysis") -> DataFrame:
    """Adds reason and selected: best of each time bucket, then the best of the rest up to the limit."""
    rows = acqs.withColumn("gate", gate_reason(max_cloud, min_coverage))
    ok, order = F.col("gate").isNull(), [cloud_key(F.col("cloud")), F.col("ts"), F.col("key")]
    span = F.greatest(F.lit(1.0), (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6)
    gone = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
    bucket = F.least(F.greatest(F.floor(gone / (span / limit)), F.lit(0)), F.lit(limit - 1))
    rows = rows.withColumns({"n_ok": F.count_if(ok).over(Window.partitionBy(by)), "bucket": bucket})
    rows = rows.withColumn("first", ok & (F.row_number().over(Window.partitionBy(by, ok, "bucket").orderBy(*order)) == 1))
    rows = rows.withColumn("picked", F.count_if("first").over(Window.partitionBy(by)))
    rest = F.row_number().over(Window.partitionBy(by, ok, "first").orderBy(*order))
    chosen = ok & ((F.col("n_ok") <= limit) | F.col("first") | (rest <= limit - F.col("picked")))
    rows = rows.withColumn("selected", chosen)
    reason = F.when(F.col("selected"), F.lit(None)).otherwise(F.coalesce("gate", F.lit("not_selected_temporal_sampling")))
    return rows.withColumn("reason", reason).select(*acqs.columns, "selected", "reason")


def select_seasonal(acqs: DataFrame, month: int, day: int, tolerance: int, limit: int, max_cloud: float = 20.0, min_coverage: float = 99.0, by: str = "analysis") -> DataFrame:
    """Adds distance, reason, selected: the best of each year near a day of year, years thinned evenly to the limit."""
    rows = acqs.withColumns({"distance": day_distance(F.col("ts"), month, day), "y": F.year("ts")})
    rows = rows.withColumn("gate", F.coalesce(gate_reason(max_cloud, min_coverage), F.when(F.col("distance") > tolerance, "outside_seasonal_window")))
    ok = F.col("gate").isNull()
    best = F.row_number().over(Window.partitionBy(by, ok, "y").orderBy(cloud_key(F.col("cloud")), "distance", "key"))
    rows = rows.withColumn("first", ok & (best == 1))
    # Among rows that pass the gates every year has a first, so a year's rank is its place.
    place = F.dense_rank().over(Window.partitionBy(by, ok).orderBy("y")) - 1
    rows = rows.withColumn("years", F.count_if("first").over(Window.partitionBy(by)))
    step = (F.col("years") - 1).cast("double") / max(1, limit - 1)
    spots = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * step, 0).cast("long")) if limit > 1 else F.array((F.col("years") - 1).cast("long"))
    kept = (F.col("years") <= limit) | F.array_contains(spots, place.cast("long"))
    rows = rows.withColumn("year_kept", kept).withColumn("selected", F.col("first") & F.col("year_kept"))
    left = F.when(~F.col("year_kept"), "not_selected_year_sampling").otherwise("not_selected_temporal_sampling")
    reason = F.when(F.col("selected"), F.lit(None)).otherwise(F.coalesce("gate", left))
    return rows.withColumn("reason", reason).select(*acqs.columns, "distance", "selected", "reason")


def partition_check(rows: DataFrame, by: str = "analysis") -> DataFrame:
    """(by, candidates, selected, excluded, reasons, whole): whether every candidate is either selected or excluded for one
    reason, never both or neither; reasons: the number of excluded rows of each, as `reason=n` in order."""
    counts = rows.groupBy(by, "selected", "reason").agg(F.count("*").alias("n"))
    told = F.when(~F.col("selected") & F.col("reason").isNotNull(), F.concat_ws("=", "reason", F.col("n").cast("string")))
    sound = F.sum(F.when(F.col("selected") & F.col("reason").isNull() | ~F.col("selected") & F.col("reason").isNotNull(), F.col("n")).otherwise(0))
    out = counts.groupBy(by).agg(
        F.sum("n").alias("candidates"), F.sum(F.when(F.col("selected"), F.col("n")).otherwise(0)).alias("selected"), F.sum(F.when(~F.col("selected"), F.col("n")).otherwise(0)).alias("excluded"),
        F.array_sort(F.collect_list(told)).alias("reasons"), sound.alias("_sound"),
    )
    return out.withColumn("whole", F.col("_sound") == F.col("candidates")).drop("_sound")
