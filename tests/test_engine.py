"""Grids, whole acquisitions, processing, rasters, provenance, the store and the queue: analytic values and defined cases."""

import json
import re
import struct
from datetime import date, datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from conftest import DATA
from test_products import read_png
from verdara.functions import formatting, polygons, projection
from verdara.operators import acquisition, grid, process, raster, requests, store
from verdara.plans.registry import QUERIES
from verdara.sinks import images, provenance
from verdara.sources import catalog, rasters, stac_items
from verdara.streaming import jobs, state

SQUARE = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
RING = "array<struct<x:double,y:double>>"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def ring_of(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_demo_grid_and_cells(spark):
    """The published demonstration's grid and its count of cells inside."""
    w, s, e, n = -83.30, 42.22, -83.15, 42.32
    box = [(w, s), (e, s), (e, n), (w, n)]
    g = grid.canonical_grids(spark.range(1).select(ring_of(box).alias("ring"))).cache()
    r = g.first()
    assert r["epsg"] == 32617 and r["problem"] is None and r["left"] % 10 == 0 and r["width"] == (r["right"] - r["left"]) / 10 and r["transform"] == [10.0, 0.0, r["left"], 0.0, -10.0, r["top"]]
    assert r["signature"] == f"EPSG:32617:{r['width']}x{r['height']}:10,0,{r['left']:.6g},0,-10,{r['top']:.6g}"
    assert r["bounds_geographic"][0] <= w and r["bounds_geographic"][3] >= n and r["bounds_geographic"][1] == pytest.approx(s, abs=0.01)
    inside = grid.cells(g).where("in_aoi").count()
    assert inside * 100 / 1e6 == pytest.approx(one(spark, polygons.geodesic_ring_km2(ring_of(box)))[0], rel=2e-3)
    lon, lat = one(spark, *projection.lonlat(*projection.utm_xy(F.lit(-83.2), F.lit(42.3), F.lit(32617)), F.lit(32617)))
    assert (lon, lat) == (pytest.approx(-83.2, abs=1e-9), pytest.approx(42.3, abs=1e-9))
    shown = [one(spark, grid.six_digits(F.lit(float(v))))[0] for v in (0, 10, -10, 123456, 4691230, 0.5, 1234567.0, 0.00001234)]
    assert shown == [f"{v:.6g}" for v in (0, 10, -10, 123456, 4691230, 0.5, 1234567.0, 0.00001234)]
    doc = json.loads(g.select(F.to_json(grid.grid_document(F.lit("x"))).alias("d")).first()["d"])
    assert doc["crs"] == "EPSG:32617" and len(doc["transform"]) == 6 and doc["schema_version"] == "1.0.0"
    far = spark.createDataFrame([("in", [w, s, e, n]), ("out", [0.0, 0.0, 1.0, 1.0])], "item_id string, bbox array<double>")
    assert [x["item_id"] for x in grid.granules_on_grid(far, g).collect()] == ["in"]


def test_ring_problems(spark):
    bow = [(0, 0), (1, 1), (1, 0), (0, 1)]
    assert one(spark, *[projection.ring_problem(ring_of(r)) for r in (SQUARE, bow, [(0, 0), (1, 1)], [(0, 0), (1, 1), (2, 2)])], projection.ring_problem(F.lit(None).cast(RING))) == (None, "self_intersection", "too_few_points", "no_area", "too_few_points")
    assert one(spark, *projection.ring_centroid(ring_of(SQUARE))) == (0.5, 0.5)


def test_grids_are_made_by_compiled_steps(spark, capsys):
    """Back to degrees without lambdas, in methods that the JVM compiles (8000 bytes at most); a ring's sides are made once for its centre."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        QUERIES["canonical_grid"](spark, f"{DATA}/sf0.001").explain(mode="codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    told = capsys.readouterr().out
    assert ".asin(" in told and max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", told)) < 8000
    plan = QUERIES["canonical_grid"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(") == 1


def test_whole_numbers_in_six_digits(spark):
    """Cut from their digits or formatted, they are as C writes them."""
    values = [float(s * v) for s in (1, -1) for v in (1, 10, 999_999, 1e6, 1_000_010, 1_234_567, 1_234_560, 1_000_001, 9_999_990, 9_999_996, 1e7, 12_345_600, 1e14, 123_456e9, 1e15, 1e16, 1.5e20, 1e300)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", grid.six_digits(F.col("v")).alias("text")).collect()
    assert [r["text"] for r in got] == [f"{r['v']:.6g}" for r in got] and len(got) == len(values)


def test_middle_of_odd_rings(spark):
    """Closed and open rings are one; without an area, the mean of the corners; none has none."""
    rings = [[(0, 0), (4, 0), (0, 2)], [(0, 0), (4, 0), (0, 2), (0, 0)], [(0, 2), (4, 0), (0, 0)], [(1, 1), (2, 2), (6, 6)], [(3, 5)], None]
    table = [(k, r and [{"x": float(x), "y": float(y)} for x, y in r]) for k, r in enumerate(rings)]
    got = [tuple(r["c"]) for r in spark.createDataFrame(table, f"id int, ring {RING}").select("id", projection.ring_middle(F.col("ring")).alias("c")).orderBy("id").collect()]
    third = pytest.approx((4 / 3, 2 / 3), rel=1e-15)
    assert got[:3] == [third] * 3 and got[3:] == [(3.0, 3.0), (3.0, 5.0), (None, None)]
    empty = grid.canonical_grids(spark.createDataFrame(table[5:], f"id int, ring {RING}")).first()
    assert empty["problem"] == "too_few_points" and empty["epsg"] is None and empty["signature"] is None


def test_seam_makes_one_acquisition(spark):
    ids = ["S2A_MSIL2A_20240701T163000_R040_T17TLH_20240701T200000", "S2A_MSIL2A_20240701T163000_R040_T17TLG_20240701T210000"]
    at = datetime(2024, 7, 1, 16, 30)
    rows = [(ids[0], "c", at, 10.0, "Sentinel-2A", "05.10", {"red": "a"}, 60.0, None), (ids[1], "c", at, None, "Sentinel-2A", "", {"red": "b"}, None, None), ("x", "c", at, 1.0, None, None, None, None, None)]
    g = spark.createDataFrame(rows, f"item_id string, collection string, observed_at timestamp, cloud_cover_pct double, platform string, processing_baseline string, assets map<string,string>, aoi_overlap_pct double, footprint array<{RING}>")
    got = {r["acquisition_key"]: r for r in acquisition.acquisition_records(g).collect()}
    a = got["c|sentinel-2a|R040|2024-07-01T16:30:00+00:00"]
    assert len(got) == 2 and a["granule_count"] == 2 and a["tile_ids"] == ["T17TLG", "T17TLH"] and a["item_ids"] == sorted(ids) and a["primary_item_id"] == ids[0]
    assert a["cloud_cover_pct"] == 10.0 and a["processing_baselines"] == ["05.10"] and a["dominant_baseline"] == "05.10" and a["assets"] == {ids[0]: {"red": "a"}, ids[1]: {"red": "b"}} and "mosaic of 2 granules: T17TLG, T17TLH" in a["warnings"][0]
    other = got["c|unknown|Rxxx|2024-07-01T16:30:00+00:00"]
    assert other["dominant_baseline"] is None and other["warnings"] == [] and other["spread_us"] == 0 and other["relative_orbit"] is None


def test_processing_of_degenerate_acquisitions(spark):
    """Rejections in their order: no overlap, coverage, masked, sparse; a whole one passes."""
    size, cells = 10, [(r, c, True) for r in range(10) for c in range(10)]
    kinds = {"whole": (100, 4, 0), "none": (0, 4, 0), "part": (56, 4, 0), "cloudy": (100, 9, 0), "sparse": (100, 9, 5), "seam": (100, 4, 0)}
    rows = []
    for name, (covered, scl, clear) in kinds.items():
        for item in ("b", "a") if name == "seam" else ("a",):
            for r, c, _ in cells:
                k = r * size + c
                inside = k < covered if name != "seam" else (k < 60) == (item == "a")
                for band, v in (("red", 3000.0), ("nir", 6000.0), ("scl", float(4 if k < clear else scl))):
                    rows.append((name, item, r, c, band, v if inside else None, inside))
    granules = spark.createDataFrame(rows, "acquisition string, item_id string, row int, col int, band string, value double, covered boolean")
    acqs = spark.createDataFrame([(n, "05.00" if n != "whole" else "03.01", ["a", "b"]) for n in kinds], "acquisition string, dominant_baseline string, item_ids array<string>")
    got = {r["acquisition"]: r for r in process.process_acquisitions(acqs, granules, spark.createDataFrame(cells, "row int, col int, in_aoi boolean")).collect()}
    assert {n: r["reason"] for n, r in got.items()} == {"whole": None, "none": "no_raster_overlap_with_aoi", "part": "insufficient_aoi_coverage", "cloudy": "all_pixels_masked", "sparse": "insufficient_valid_pixels", "seam": None}
    assert got["whole"]["ndvi_mean"] == pytest.approx(1 / 3, abs=1e-6) and got["seam"]["ndvi_mean"] == pytest.approx((0.5 - 0.2) / 0.7, abs=1e-6) and got["seam"]["ndvi_std"] == 0
    assert got["seam"]["contributing_item_ids"] == ["a", "b"] and got["whole"]["contributing_item_ids"] == ["a"] and got["none"]["contributing_item_ids"] == ["a", "b"] and got["none"]["aoi_px"] is None
    assert got["part"]["coverage_pct"] == 56.0 and got["part"]["missing_data_pct"] == 44.0 and "56.00" in got["part"]["process_warnings"][0] and got["sparse"]["valid_pixel_pct"] == 5.0
    results = process.process_acquisitions(acqs, granules, spark.createDataFrame(cells, "row int, col int, in_aoi boolean"))
    assert process.require_usable(results).count() == 6
    with pytest.raises(process.NoUsableData, match="all_pixels_masked, insufficient_valid_pixels"):
        process.require_usable(results.where("acquisition in ('cloudy', 'sparse')"))
    assert [process.failure_category(e) for e in (process.UserInput(), process.Transient(), TimeoutError(), KeyError())] == ["user_input", "transient", "timeout", "internal"]
    assert one(spark, process.empty_statistics(F.lit(9)))[0]["masked_px"] == 9


def test_one_exchange_for_statistics(spark):
    plan = raster.scene_summary(raster.index_pixels(spark.createDataFrame([(1, 1000, 2000, 4, True, True)], "acquisition int, red_dn int, nir_dn int, scl int, covered boolean, in_aoi boolean")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    search = QUERIES["catalog_search_capped"](spark, f"{DATA}/sf0.001")
    text = search._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") >= 4 and "NestedLoop" not in text


def test_search_predicates(spark):
    rows = [("a", datetime(2024, 1, 2), 1.0, "c", [0.0, 0.0, 1.0, 1.0]), ("b", datetime(2024, 1, 2), 1.0, "c", [5.0, 5.0, 6.0, 6.0]), ("d", datetime(2024, 1, 2), 1.0, "x", [0.0, 0.0, 1.0, 1.0]), ("e", datetime(2024, 3, 2), 1.0, "c", [0.0, 0.0, 1.0, 1.0])]
    items = spark.createDataFrame(rows, "item_id string, ts timestamp, cloud double, collection string, bbox array<double>")
    found = catalog.search(items, catalog.windows(spark, date(2024, 1, 1), date(2024, 1, 30), 8), 30.0, 1, "c", (0.5, 0.5, 2.0, 2.0))
    assert [(r["item_id"], r["truncated"]) for r in found.collect()] == [("a", True)]


def test_rasters_read_by_windows(spark, tmp_path):
    values = np.random.default_rng(2).random((700, 600)).astype("f4")
    values[5, 7] = np.nan
    (tmp_path / "a.tif").write_bytes(images.geotiff(values, 300000.0, 4700000.0, 10.0, 32617))
    (tmp_path / "b.tif").write_bytes(b"no raster")
    whole = np.arange(12, dtype=">u2").reshape(3, 4)
    tags = [(256, 3, 4), (257, 3, 3), (258, 3, 16), (259, 3, 1), (273, 4, 200), (277, 3, 1), (278, 3, 3), (279, 4, 24)]
    head = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags) + b"\0" * 4
    (tmp_path / "c.tif").write_bytes(head.ljust(200, b"\0") + whole.tobytes())
    files = rasters.files(spark, str(tmp_path))
    heads = {r["path"][-5]: r for r in rasters.headers(files).collect()}
    a = heads["a"]
    assert (a["width"], a["height"], a["dtype"], a["epsg"], a["left"], a["top"], a["nodata"], a["block"], a["overviews"], a["problem"]) == (600, 700, "float32", 32617, 300000.0, 4700000.0, -9999.0, [256, 256], 2, None)
    assert heads["b"]["problem"].startswith("unreadable") and heads["c"]["problem"] == "no_georeference" and heads["c"]["dtype"] == "uint16"
    part = rasters.windows(files.where("path like '%a.tif'"), (300050.0, 4699000.0, 300100.0, 4699990.0), pad=2).collect()
    assert {(r["row"], r["col"]) for r in part} == {(r, c) for r in range(0, 102) for c in range(3, 12)}
    assert all(r["value"] is None if (r["row"], r["col"]) == (5, 7) else r["value"] == values[r["row"], r["col"]] for r in part)
    assert [r["value"] for r in rasters.windows(files.where("path like '%c.tif'")).orderBy("row", "col").collect()] == list(range(12))


def test_provenance_document(spark):
    analysis = spark.createDataFrame([("e28949cd-9325-4767-bb44-43d425f78061",)], "analysis_id string").select(
        "analysis_id", F.lit("2024-08-01T00:00:00Z").alias("created_at"), F.lit("https://example.org/stac").alias("stac_endpoint"), F.lit("s2").alias("collection"),
        F.struct(F.lit("{}").alias("aoi_geometry"), F.lit("2024-01-01").alias("start_date"), F.lit("2024-02-01").alias("end_date"), F.lit(20.0).alias("max_cloud_cover_pct")).alias("request"),
        F.struct(*[F.lit("x").alias(c) for c in ("schema_version", "crs", "resolution", "bounds_projected", "bounds_geographic")], F.array(*[F.lit(1.0)] * 6).alias("transform"), F.lit(3).alias("width"), F.lit(4).alias("height")).alias("canonical_grid"),
        F.struct(F.lit(1).alias("window_count")).alias("catalog_search"), F.lit("temporal").alias("algorithm"), F.lit("2.0.0").alias("algorithm_version"), F.lit(99.0).alias("min_aoi_coverage_pct"), F.struct(F.lit(1.5).alias("duration_seconds")).alias("timing"),
    )
    key = analysis.select("analysis_id")
    scenes = key.select("analysis_id", F.lit("k\"1").alias("acquisition_key"), F.lit("i").alias("primary_item_id"), F.array(F.lit("i")).alias("contributing_item_ids"), F.lit("2024-01-05").alias("observed_at"), F.create_map(F.lit("i"), F.lit("h")).alias("assets"), F.lit(None).cast("string").alias("platform"))
    outputs = key.select("analysis_id", F.lit("ndvi_cog").alias("artifact_type"), F.lit("p").alias("path"), F.lit("a" * 64).alias("sha256"), F.lit(7).alias("size_bytes"))
    excluded = key.select("analysis_id", F.lit("k2").alias("acquisition_key"), F.lit("cloud").alias("reason"))
    made = provenance.problems(provenance.build(analysis, excluded, scenes, outputs, raster.MASKED, {"a": "b"}, {"processing_version": "2"})).first()
    doc = json.loads(made["document"])
    assert made["problems"] == [] and doc["scenes"][0]["acquisition_key"] == 'k"1' and doc["scenes"][0]["platform"] is None and doc["scene_selection"]["selected_count"] == 1 and doc["scene_selection"]["excluded"] == [{"acquisition_key": "k2", "reason": "cloud"}]
    assert doc["processing"]["mosaic_method"] == "first-valid-by-item-id" and doc["processing"]["masked_scl_class_names"][-1] == "SNOW_OR_ICE" and doc["timing"] == {"duration_seconds": 1.5}
    doc["outputs"][0]["sha256"] = "zz"
    doc["canonical_grid"]["transform"] = [1.0]
    del doc["request"]["end_date"], doc["scenes"][0]["assets"]
    broken = spark.createDataFrame([(json.dumps(doc),), ("no json",)], "document string")
    told = [r["breaches"] for r in provenance.breaches(spark.createDataFrame([(made["document"],), *map(tuple, broken.collect())], "document string")).collect()]
    assert told[0] == [] and sorted(told[1]) == ["$.canonical_grid.transform: minItems", "$.outputs[0].sha256: pattern", "$.request.end_date: required", "$.scenes[0].assets: required"] and told[2] == ["$: not json"]
    told = [r["problems"] for r in provenance.problems(broken).collect()]
    assert told[0] == ["missing request.end_date", "canonical_grid.transform hasn't six numbers", "scenes[0]: assets", "outputs[0]: sha256 is no digest"] and len(told[1]) == len(provenance.REQUIRED)


def test_store_changes(spark, tmp_path):
    analyses = spark.createDataFrame([(1, "succeeded", "1.0.0", False, 1, "g"), (2, "running", "1.2.0", False, 2, None), (3, "succeeded", "2.0.0", True, 3, "g"), (4, "succeeded", "x", True, 4, "g")], "id int, status string, processing_version string, is_demo boolean, submitted_at int, grid string")
    files = spark.createDataFrame([(1, 2_000_000), (1, 1_000_000), (3, 5)], "analysis_id int, size_bytes int")
    plan = store.deletion_plan(analyses, files, legacy=True)
    assert sorted((r["id"], r["n_artifacts"], r["size_mb"], r["refused"]) for r in plan.collect()) == [(1, 2, 3.0, None), (2, 0, 0.0, "in_flight"), (4, 0, 0.0, "demo")]
    tables = {"analyses": (analyses, "id"), "files": (files, "analysis_id")}
    with pytest.raises(ValueError, match="2: in_flight, 4: demo"):
        store.delete_analyses(plan, tables)
    left = store.delete_analyses(store.deletion_plan(analyses, files, ids=[1]), tables)
    assert left["analyses"].count() == 3 and left["files"].count() == 1
    with pytest.raises(ValueError):
        store.deletion_plan(analyses, files)
    assert sorted(r["id"] for r in store.demo_present(analyses).collect()) == [3, 4]
    path = str(tmp_path / "t")
    for rows in ([(1, "a"), (2, "b")], [(2, "c")]):
        store.replace_attempt(spark.createDataFrame(rows, "analysis_id int, v string"), path)
    assert sorted((r["analysis_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    for bad in ((0, 0), (101, 0), (1, -1)):
        with pytest.raises(ValueError):
            store.page(files, "size_bytes", "analysis_id", *bad)
    assert one(spark, store.contributing(F.array().cast("array<string>"), F.lit("i")), store.contributing(F.array(F.lit("a")), F.lit("i"))) == (["i"], ["a"])
    new = spark.createDataFrame([(1, None)], "k int, v string")
    assert store.upsert(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), new, "k").orderBy("k").collect() == [(1, None), (2, "y")]
    assert stac_items.fresh(new, new.where("false"), "k").count() == 1


def test_rate_limit_rule(spark):
    """Against a plain walk; an accepted event counts up to and with its 3600th second."""
    sf = f"{DATA}/sf0.01"
    events = sorted(duckdb.sql(f"SELECT user_id, epoch_us(ts), event_id FROM '{sf}/events.parquet'").fetchall())
    held, want = {}, {}
    for user, at, event in events:
        times = held[user] = [t for t in held.get(user, []) if at - t <= 86_400_000_000]
        want[event] = len(times) < 2
        if want[event]:
            times.append(at)
    got = {r["event_id"]: r["accepted"] for r in QUERIES["rate_limit_exact"](spark, sf).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)
    edge = spark.createDataFrame([("a", datetime(2024, 1, 1), 1), ("a", datetime(2024, 1, 1, 1), 2), ("a", datetime(2024, 1, 1, 1, 0, 1), 3)], "client string, ts timestamp, id int")
    assert {r["id"]: r["accepted"] for r in jobs.rate_limited_batch(edge, 1).collect()} == {1: True, 2: False, 3: True}


def run_stream(spark, tmp_path, rows, make, name):
    for k, part in enumerate(rows):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        frame = spark.readStream.schema(part.schema).parquet(str(tmp_path / name))
        query = make(frame).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def test_claims_and_deliveries_across_batches(spark, tmp_path):
    schema = "analysis_id string, at timestamp, event string"
    first = spark.createDataFrame([("x", datetime(2024, 1, 1, 0), "claim"), ("x", datetime(2024, 1, 1, 1), "claim"), ("y", datetime(2024, 1, 1), "claim")], schema)
    later = spark.createDataFrame([("x", datetime(2024, 1, 1, 3), "claim"), ("y", datetime(2024, 1, 1, 1), "done"), ("y", datetime(2024, 1, 2), "claim")], schema)
    got = run_stream(spark, tmp_path, [first, later], state.claims, "claims").collect()
    assert sorted((r["analysis_id"], r["at"].day, r["at"].hour, r["granted"]) for r in got) == [("x", 1, 0, True), ("x", 1, 1, False), ("x", 1, 3, True), ("y", 1, 0, True), ("y", 2, 0, False)]
    names = "message_id string, analysis_id string, enqueued_at timestamp, received_at timestamp"
    at = [datetime(2024, 1, 1, 0, m) for m in range(6)]
    batches = [spark.createDataFrame([("m", "a", at[0], at[1]), ("m", "a", at[0], at[2]), ("n", "", at[3], at[2])], names), spark.createDataFrame([("m", "a", at[0], at[3]), ("m", "a", at[0], at[4])], names)]
    found = jobs.delivered(run_stream(spark, tmp_path, batches, jobs.counted, "messages")).collect()
    assert sorted((r["message_id"], r["dequeue_count"], r["poison"], r["delay_s"]) for r in found) == [("m", 1, False, 60.0), ("m", 2, False, 120.0), ("m", 3, False, 180.0), ("m", 4, True, 240.0), ("n", 1, True, 0.0)]
    runs = spark.createDataFrame([("succeeded", 1.0, 0.5), ("failed", 3.0, 0.1)], "status string, seconds double, delay_s double")
    r = jobs.job_metrics(runs).first()
    assert (r["succeeded"], r["failed"]) == (1, 1) and len(r["seconds_histogram"]) == 2


def test_deadline_cancels_jobs(spark):
    slow = F.udf(lambda x: __import__("time").sleep(60) or x, "long")
    with pytest.raises(TimeoutError) as e, jobs.deadline(spark, 2):
        spark.range(2).select(slow("id")).collect()
    assert process.failure_category(e.value) == "timeout" and spark.range(3).count() == 3
    with jobs.deadline(spark, 100):
        assert spark.range(4).count() == 4
    with pytest.raises(KeyError), jobs.deadline(spark, 100):
        raise KeyError


def test_true_colour_files(spark):
    """The files decode to the pixels that the oracle checks; every second cell is taken, the first row transparent."""
    sf = f"{DATA}/sf0.001"
    want = {(r["label"], r["row"], r["col"]): [r["r"], r["g"], r["b"], r["alpha"]] for r in QUERIES["true_colour_pixels"](spark, sf).collect()}
    made = {r["label"]: read_png(bytes(r["content"])) for r in images.png_images(QUERIES["true_colour_pixels"](spark, sf), "label").collect()}
    assert {(k, y, x): p[y, x].tolist() for k, p in made.items() for y in range(4) for x in range(4)} == want
    assert all(p.shape == (4, 4, 4) and not p[0, :, 3].any() and p[1:, :, 3].all() for p in made.values())
    assert QUERIES["true_colour_previews"](spark, sf).count() == len(made)
    whole = spark.createDataFrame([(1, 0, 0, 9, 8, 7)], "k int, row int, col int, red int, green int, blue int")
    assert raster.true_colour(whole, 1).first() == (1, 0, 0, 9, 8, 7, 255)


def test_software_and_dataset(spark, tmp_path):
    (tmp_path / "lock").write_bytes(b"abc")
    s = provenance.software(spark, "2.0.0", str(tmp_path / "lock"), ("numpy", "no-such-package"), git_commit_sha="c")
    assert s["package_numpy"] == np.__version__ and s["package_no-such-package"] == "unknown" and s["dependency_lock_sha256"].startswith("ba7816bf") and s["git_commit_sha"] == "c"
    assert "dependency_lock_sha256" not in provenance.software(spark, "2.0.0", str(tmp_path / "none"))
    d = provenance.dataset(spark, "c", "https://example.org/stac", {"red": "B04"}, "T").first()
    assert d["id"] == "c" and d["assets_used"] == {"red": "B04"} and d["gsd_meters"] == 10 and d["license"] == provenance.SOURCE["license"]


def test_limits_and_words(spark):
    strict = requests.Limits(demo=True, max_area_km2=200.0).effective()
    assert strict.max_area_km2 == 200.0 and strict.max_custom_area_km2 == 200.0 and strict.max_scenes == 8
    assert requests.Limits().effective().max_area_km2 == 600.0
    f = formatting
    assert one(spark, *[f.size(F.lit(n)) for n in (0, 1023, 1536, 20971520, 3 * 1024**4, -1)]) == ("0 B", "1023 B", "1.5 KB", "20 MB", "3.0 TB", "—")
    assert one(spark, f.number(F.lit(-0.5)), f.change(F.lit(0.0)), f.percent(F.lit(93.5)), f.km2(F.lit(12.34)), f.area_limit(F.lit(0.5)), f.area_limit(F.lit(1250.0)), f.day_span(F.lit(3660))) == ("−0.500", "±0.000", "93.5%", "12.3 km²", "0.5 km²", "1,250 km²", "3,660 days (about 10 years)")
    none = F.lit(None).cast("double")
    assert one(spark, f.number(none), f.km2(F.lit(float("nan"))), f.day(F.lit("")), f.day(F.lit("2024-06-01T16:39:01Z")), f.minute(F.lit("2024-06-01T16:39:01Z")), f.minute(F.lit("soon")), f.short_digest(F.lit("0123456789"))) == ("—", "—", "—", "2024-06-01", "2024-06-01 16:39 UTC", "soon", "01234567")
    assert one(spark, f.granules(F.lit(1), F.array(F.lit("T"))), f.granules(F.lit(2), F.array(F.lit("T1"), F.lit("T2"))), f.truncate_middle(F.lit("S2A_MSIL2A_20240701T163000_T17TKG"))) == ("1 granule", "2 granules · T1, T2", "S2A_MSIL2A_…3000_T17TKG")
    assert one(spark, requests.one_source(F.lit(1), F.lit(None)), requests.one_source(F.lit(1), F.lit(2)), requests.one_source(F.lit(None), F.lit(None))) == (True, False, False)
