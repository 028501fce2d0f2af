"""Catalogue search: equal date windows, a cap on each, deduplication, truncation flags."""

from __future__ import annotations

import math
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def windows(spark: SparkSession, start: date, end: date, days: int = 370) -> DataFrame:
    """(window_id, ws, we): consecutive inclusive windows of equal size, none longer than `days`."""
    if end < start:
        raise ValueError("end before start")
    span = (end - start).days + 1
    size = math.ceil(span / math.ceil(span / days))
    rows = [(i, start + timedelta(i * size), min(end, start + timedelta((i + 1) * size - 1))) for i in range(math.ceil(span / size))]
    return spark.createDataFrame(rows, "window_id int, ws date, we date")


def search(items: DataFrame, wins: DataFrame, max_cloud: float, cap: int, collection: str | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Items below the cloud limit, of a collection and meeting a bbox if they are given, the first `cap` of each
    window, one row an item (the last window wins), by time and item.

    Windows are equal and consecutive, so an item's window is arithmetic, not a join. A window is truncated when it
    has a row of rank `cap`, so nothing counts the rows beyond the cap: each task passes on `cap` of a window.
    """
    first = wins.orderBy("window_id").collect()  # a few rows, made above
    start, size, end = first[0]["ws"], (first[0]["we"] - first[0]["ws"]).days + 1, first[-1]["we"]
    day = F.to_date("ts")
    hit = items.where((F.col("cloud") < max_cloud) & day.between(F.lit(start), F.lit(end)))
    if collection is not None:
        hit = hit.where(F.col("collection") == collection)
    if bbox is not None:
        w, s, e, n = (F.get("bbox", F.lit(k)) for k in range(4))
        hit = hit.where((w <= bbox[2]) & (e >= bbox[0]) & (s <= bbox[3]) & (n >= bbox[1]))
    hit = hit.withColumn("window_id", F.floor(F.datediff(day, F.lit(start)) / size).cast("int"))
    by = Window.partitionBy("window_id")
    kept = hit.withColumn("rn", F.row_number().over(by.orderBy("ts", "item_id"))).where(F.col("rn") <= cap)
    kept = kept.withColumn("truncated", F.max("rn").over(by) >= cap)
    last = Window.partitionBy("item_id").orderBy(F.col("window_id").desc())
    return kept.withColumn("k", F.row_number().over(last)).where("k = 1").select("item_id", "ts", "cloud", "window_id", "truncated").orderBy("ts", "item_id")


def search_metadata(found: DataFrame, wins: DataFrame, cap: int) -> DataFrame:
    """One row: how the catalogue was asked, and how many granules came."""
    cut = found.groupBy("window_id").agg(F.bool_or("truncated").alias("t"), F.count("*").alias("n"))
    span = F.concat_ws("/", F.col("ws").cast("string"), F.col("we").cast("string"))
    rows = wins.join(cut, "window_id", "left").agg(
        F.count("*").alias("window_count"), F.array_sort(F.collect_list(span)).alias("windows"), F.array_sort(F.collect_list(F.when(F.col("t"), span))).alias("truncated_windows"), F.sum(F.coalesce("n", F.lit(0))).alias("granules_returned"),
    )
    return rows.withColumn("max_items_per_window", F.lit(cap))
