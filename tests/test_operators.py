"""Analytic values of the operators and the streaming forms."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from verdara.functions import geo
from verdara.operators import raster, selection
from verdara.sources import catalog
from verdara.streaming import jobs, state


def values(df):
    return [tuple(r) for r in df.collect()]


def test_ndvi_values(spark):
    cases = [(0.1, 0.3, 0.5), (0.2, 0.2, 0.0), (0.3, 0.1, -0.5), (0.0, 0.0, None), (-0.05, 0.2, 1.0), (0.2, -0.1, -1.0), (0.001, -0.001, -1.0), (None, 0.2, None), (1.0, 0.0, -1.0), (0.0, 1.0, 1.0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, red double, nir double, want double")
    for r in df.select("want", raster.ndvi(F.col("red"), F.col("nir")).alias("got"), raster.zero_denominator(F.col("red"), F.col("nir")).alias("zero"), "i").collect():
        assert r["got"] == pytest.approx(r["want"], abs=1e-6) if r["want"] is not None else r["got"] is None
        assert r["zero"] == (r["i"] == 3)


def test_scaling_and_mask(spark):
    df = spark.createDataFrame([("05.00", None), ("03.01", None), (None, None), ("x", None), ("05.00", 2e-4)], "b string, s double")
    got = values(df.select(raster.band_scaling(F.col("b"), F.col("s"), F.col("s") * -1000).alias("r")).select("r.*"))
    assert [(g[1], g[2]) for g in got] == [(-0.1, "baseline_heuristic"), (0.0, "baseline_heuristic"), (-0.1, "default"), (-0.1, "default"), (-0.2, "raster_ext")]
    scl = spark.createDataFrame([(c,) for c in (4, 6, 5, 2, 9, 3, 10, 11, 0, None)], "c int")
    assert [r[0] for r in values(scl.select(raster.scl_valid(F.col("c"))))] == [True] * 4 + [False] * 6
    assert [r[0] for r in values(scl.select(raster.scl_valid(F.col("c"), ())))] == [True] * 9 + [False]


def test_utm_area_and_bbox(spark):
    df = spark.createDataFrame([(-83.1, 42.35, 32617), (-179.9, 10.0, 32601), (179.9, 10.0, 32660), (-58.4, -34.6, 32721)], "lon double, lat double, want int")
    assert all(a == b for a, b in values(df.select("want", geo.utm_epsg(F.col("lon"), F.col("lat")))))
    box = [F.lit(x) for x in (-83.30, 42.55, -83.15, 42.65)]
    half = (box[0], box[1], F.lit(-83.225), box[3])
    got = spark.range(1).select(geo.bbox_area_km2(*box), geo.bbox_overlap_pct(tuple(box), half), geo.bbox_overlap_pct(tuple(box), tuple(box)), geo.bbox_problem(*box)).first()
    assert got[0] == pytest.approx(136.7476, abs=1e-3) and got[1] == pytest.approx(50, abs=0.01) and got[2] == pytest.approx(100) and got[3] is None


def acquisitions(spark, rows):
    first = datetime(2024, 5, 1)
    return spark.createDataFrame([(k, first + timedelta(d), c, v, 0) for k, d, c, v in rows], "key string, ts timestamp_ntz, cloud double, coverage double, analysis int")


def temporal(spark, rows, limit=4):
    got = selection.select_temporal(acquisitions(spark, rows), F.lit("2024-05-01").cast("timestamp"), F.lit("2024-09-01").cast("timestamp"), limit).collect()
    return {r["key"] for r in got if r["selected"]}, {r["key"]: r["reason"] for r in got if not r["selected"]}


def test_temporal_selection(spark):
    assert temporal(spark, [("a", 1, 5.0, 100.0), ("b", 40, 8.0, 100.0)]) == ({"a", "b"}, {})
    assert temporal(spark, [("full", 1, 5.0, 100.0), ("partial", 2, 5.0, 56.2), ("cloudy", 3, 55.0, 100.0)])[1] == {"partial": "insufficient_aoi_coverage", "cloudy": "cloud_cover_above_threshold"}
    chosen, left = temporal(spark, [("may_clear", 5, 2.0, 100.0), ("may_hazy", 10, 15.0, 100.0), ("jun", 45, 5.0, 100.0), ("jul", 75, 5.0, 100.0), ("aug", 105, 5.0, 100.0), ("aug2", 110, 1.0, 100.0)])
    assert len(chosen) == 4 and "may_clear" in chosen and "may_hazy" not in chosen and set(left.values()) == {"not_selected_temporal_sampling"}
    assert temporal(spark, [("known", 5, 3.0, 100.0), ("unknown", 6, None, 100.0)], 1)[0] == {"known"}
    many = [(f"s{i}", 3 * i, float(7 * i % 19), 100.0) for i in range(30)]
    assert temporal(spark, many, 6) == temporal(spark, many[::-1], 6)


def test_seasonal_selection(spark):
    rows = [(f"y{y}", (date(y, 7, 10) - date(2024, 5, 1)).days, 5.0, 100.0) for y in range(2016, 2027)]
    got = selection.select_seasonal(acquisitions(spark, rows), 7, 15, 30, 4).collect()
    chosen = {r["key"] for r in got if r["selected"]}
    assert len(chosen) == 4 and {"y2016", "y2026"} <= chosen and {r["reason"] for r in got if not r["selected"]} == {"not_selected_year_sampling"}
    days = spark.createDataFrame([(date(2024, 7, 15),), (date(2024, 7, 5),)], "d date").select(selection.day_distance(F.col("d"), 7, 15))
    assert [r[0] for r in values(days)] == [0, 10]
    assert values(spark.createDataFrame([(date(2024, 12, 31),)], "d date").select(selection.day_distance(F.col("d"), 1, 2))) == [(2,)]


def test_windows(spark):
    wins = values(catalog.windows(spark, date(2018, 1, 1), date(2026, 6, 30)).orderBy("window_id"))
    assert wins[0][1] == date(2018, 1, 1) and wins[-1][2] == date(2026, 6, 30)
    assert all(b[1] == a[2] + timedelta(1) for a, b in zip(wins, wins[1:])) and all((w[2] - w[1]).days < 370 for w in wins)
    with pytest.raises(ValueError):
        catalog.windows(spark, date(2024, 1, 2), date(2024, 1, 1))


def test_queue_intake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join([json.dumps({"analysis_id": "x", "enqueued_at": "2024-01-01T00:00:00Z"}), "not json", "{}"]))
    raw = spark.readStream.text(str(tmp_path / "in"))
    jobs.intake(raw, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1 and spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_rate_limit_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, m)) for m in (0, 10, 20, 30)] + [("a", datetime(2024, 1, 1, 1, 5)), ("b", datetime(2024, 1, 1))], "client string, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = state.rate_limited(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 2)
    stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(90)
    got = [r["accepted"] for r in spark.table("limited").where("client = 'a'").orderBy("ts").collect()]
    assert got == [True, True, False, False, True]
