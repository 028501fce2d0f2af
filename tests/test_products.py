"""Projection, polygons, images, item rows, documents and reader views against known values."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdara.functions import projection, views
from verdara.operators import raster
from verdara.sinks import documents, images
from verdara.sources import stac_items

DEMO = (-83.30, 42.55, -83.15, 42.65)


def lits(*v):
    return [F.lit(float(x)) for x in v]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_demo_grid_from_projected_corners(spark):
    ring = projection.ring_utm(projection.bbox_ring(*lits(*DEMO)), F.lit(32617))
    xs, ys = zip(*[(p["x"], p["y"]) for p in one(spark, ring)[0]])
    snapped = [f(v / 10) * 10 for f, v in ((np.floor, min(xs)), (np.floor, min(ys)), (np.ceil, max(xs)), (np.ceil, max(ys)))]
    assert snapped == [311160, 4713080, 323770, 4724520]


def test_demo_aoi_pixels(spark):
    ring = projection.ring_utm(projection.bbox_ring(*lits(*DEMO)), F.lit(32617))
    rings = spark.range(1).select(ring.alias("ring"))
    cells = projection.rasterize(rings, "ring", 1261, 1144, 10.0, F.lit(311160.0), F.lit(4724520.0))
    assert cells.where("in_aoi").count() == 1_367_491


def test_resampling_a_plane(spark):
    source = spark.createDataFrame([(0, r, c, float(10 * r + c)) for r in range(4) for c in range(4)], "key int, row long, col long, value double")
    cells = spark.createDataFrame([(0, 0, 30.0, 50.0), (0, 1, 25.0, 60.0), (5, 5, 900.0, 0.0)], "row int, col int, x double, y double")
    near = {(r["row"], r["col"]): r["value"] for r in raster.resample_nearest(cells, source, 20.0, 0.0, 80.0).collect()}
    line = {(r["row"], r["col"]): r["value"] for r in raster.resample_bilinear(cells, source, 20.0, 0.0, 80.0).collect()}
    assert near == {(0, 0): 11.0, (0, 1): 11.0}
    assert line == {(0, 0): pytest.approx(11.0), (0, 1): pytest.approx(5 + 0.75)}


def read_png(b):
    at, parts = 8, {}
    while at < len(b):
        (n,), kind = struct.unpack(">I", b[at : at + 4]), b[at + 4 : at + 8]
        body = b[at + 8 : at + 8 + n]
        assert struct.unpack(">I", b[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        parts[kind], at = body, at + 12 + n
    w, h = struct.unpack(">II", parts[b"IHDR"][:8])
    return np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, -1)[:, 1:].reshape(h, w, -1)


def read_tiff(b):
    (at,) = struct.unpack("<I", b[4:8])
    (n,) = struct.unpack("<H", b[at : at + 2])
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack("<HHI", b[at + 2 + 12 * k : at + 10 + 12 * k])
        size, code = {2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 12: (8, "d")}[kind]
        held = b[at + 10 + 12 * k : at + 14 + 12 * k]
        data = held if size * count <= 4 else b[struct.unpack("<I", held)[0] :]
        tags[tag] = data[:count] if kind == 2 else struct.unpack(f"<{count}{code}", data[: size * count])
    w, h, side = tags[256][0], tags[257][0], tags[322][0]
    across = -(-w // side)
    out = np.zeros((-(-h // side) * side, across * side), "<f4")
    for k, (start, size) in enumerate(zip(tags[324], tags[325])):
        r, c = divmod(k, across)
        out[r * side : (r + 1) * side, c * side : (c + 1) * side] = np.frombuffer(zlib.decompress(b[start : start + size]), "<f4").reshape(side, side)
    return out[:h, :w], tags


def test_image_files(spark):
    values = np.random.default_rng(1).random((300, 270)).astype("f4")
    values[3, 4] = np.nan
    got, tags = read_tiff(images.geotiff(values, 300000.0, 4700000.0, 10.0, 32617))
    assert got[3, 4] == images.NODATA and np.array_equal(np.delete(got.ravel(), 3 * 270 + 4), np.delete(values.ravel(), 3 * 270 + 4))
    assert tags[33922][3:5] == (300000.0, 4700000.0) and tags[34735][-1] == 32617 and tags[42113] == b"-9999\0" and list(tags) == sorted(tags)
    rows = spark.createDataFrame([(1, 0, 0, 10, 20, 30, 255), (1, 1, 2, 1, 2, 3, 255), (2, 5, 5, 9, 9, 9, 0)], "acquisition int, row int, col int, r int, g int, b int, alpha int")
    made = {r["acquisition"]: read_png(bytes(r["content"])) for r in images.png_images(rows).collect()}
    assert made[1].shape == (2, 3, 4) and made[1][1, 2].tolist() == [1, 2, 3, 255] and made[1][0, 1].tolist() == [0] * 4 and made[2].shape == (1, 1, 4)
    raster_rows = spark.createDataFrame([(1, 0, 0, 0.5), (1, 1, 1, None)], "acquisition int, row int, col int, ndvi float")
    got, _ = read_tiff(bytes(images.geotiff_rasters(raster_rows, 2, 2, 0.0, 0.0, 10.0, 32617).first()["content"]))
    assert got.tolist() == [[0.5, images.NODATA], [images.NODATA, images.NODATA]]


def test_item_rows(spark):
    good = {"id": "a", "collection": "c", "geometry": {"type": "Polygon"}, "bbox": [0, 1, 2, 3], "assets": {k: {"href": k.lower()} for k in ("B04", "B08", "SCL", "visual")}, "properties": {"datetime": "2024-05-01T16:00:00Z", "eo:cloud_cover": 5, "proj:code": "EPSG:32617", "instruments": ["msi"], "s2:processing_baseline": "05.10"}}
    lost = good | {"id": "b", "assets": {"B08": {"href": "x"}}}
    late = good | {"id": "c", "properties": {"proj:epsg": "x", "proj:code": "EPSG:abc"}}
    bare = {k: v for k, v in good.items() if k not in ("geometry", "collection")} | {"id": "d"}
    rows = stac_items.granules(spark.createDataFrame([(json.dumps(x),) for x in (good, lost, late, bare)] + [("{broken",), (None,)], "item string"))
    got = {r["item_id"]: r for r in rows.collect()}
    assert got["a"]["problem"] is None and got["a"]["epsg"] == 32617 and got["a"]["assets"] == {"red": "b04", "nir": "b08", "scl": "scl", "visual": "visual"} and got["a"]["bbox"] == [0, 1, 2, 3] and got["a"]["instruments"] == ["msi"]
    assert got["b"]["problem"] == "missing_assets:red=B04,scl=SCL" and got["c"]["problem"] == "no_datetime" and got["c"]["epsg"] is None
    assert got["d"]["problem"] == "no_geometry" and got["d"]["collection"] == "unknown" and got[None]["problem"] == "no_id"
    assert stac_items.strict(rows.where("item_id = 'a'")).count() == 1
    with pytest.raises(Exception, match="missing_assets"):
        stac_items.strict(rows.where("item_id = 'b'")).collect()


def test_regions_fresh_and_documents(spark, tmp_path):
    (tmp_path / "regions.json").write_text(json.dumps({"regions": [{"slug": "x", "name": "X", "description": "d", "bbox": [0, 0, 1, 1]}]}, indent=1))
    assert [r["slug"] for r in stac_items.regions(spark, str(tmp_path / "regions.json")).collect()] == ["x"]
    rows, stored = spark.createDataFrame([(1,), (2,), (2,)], "id int"), spark.createDataFrame([(1,)], "id int")
    assert [r["id"] for r in stac_items.fresh(rows, stored).collect()] == [2]
    assert one(spark, documents.document(b=F.lit(1), a=F.lit(None).cast("int")))[0] == '{"a":null,"b":1}'
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    got = documents.artifact_rows(spark, str(tmp_path / "f")).first()
    assert got["size_bytes"] == 3 and got["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    made = spark.createDataFrame([("b", "x"), ("a", None)], "k string, v string")
    assert [r["missing"] for r in documents.provenance_problems(made, ["k", "v"]).collect()] == [["v"]]
    art = spark.createDataFrame([("1", "csv"), ("1", "log"), ("2", "csv")], "analysis_id string, artifact_type string")
    documents.export_demo(art, "1", ["csv"], str(tmp_path / "demo"))
    assert spark.read.json(str(tmp_path / "demo")).count() == 1


def test_timeseries_file(spark, tmp_path):
    kinds = {"contributing_item_ids": F.array(F.lit("i"), F.lit("j")), "observed_at": F.concat(F.lit("2024-0"), F.col("id").cast("string"))}
    rows = spark.range(1, 4).select(*[kinds.get(c, F.lit("v")).alias(c) for c in documents.TIMESERIES_COLUMNS])
    documents.write_timeseries(rows.orderBy(F.desc("observed_at")), str(tmp_path / "csv"))
    (file,) = (tmp_path / "csv").glob("*.csv")
    lines = file.read_text().split()
    assert lines[0] == ",".join(documents.TIMESERIES_COLUMNS) and len(documents.TIMESERIES_COLUMNS) == 22
    assert ["2024-0" + str(k) in x for k, x in zip((1, 2, 3), [x for x in file.read_text().split("\n")[1:] if x])] == [True] * 3 and "i j" in file.read_text()


def test_views(spark):
    assert one(spark, views.reason_label(F.lit("insufficient_aoi_coverage"), F.lit(56.2)), views.reason_label(F.lit("a_b")), views.reason_label(F.lit(None).cast("string"))) == ("Source granules covered only 56.2% of the area of interest", "a b", None)
    assert one(spark, views.describe_strategy(F.lit("seasonal"), F.lit(7)), views.describe_strategy(F.lit("temporal"), F.lit(7)), views.describe_strategy(F.lit("other"), F.lit(None).cast("int"))) == ("Same season each year (target: July)", "Spread across the range", "other")
    month = lambda a, b: views.midpoint_month(F.lit(a).cast("date"), F.lit(b).cast("date"))
    assert one(spark, month("2024-06-01", "2024-08-31"), month("2024-08-31", "2024-06-01")) == (7, None)
    assert one(spark, *views.normal_bbox(*lits(3, 4, 1, 2))) == (1, 2, 3, 4)
    assert one(spark, *views.overlay_xy(*lits(-83.225, 42.65), tuple(lits(*DEMO)), 100, 50)) == (pytest.approx(50), pytest.approx(0))
    assert [tuple(r) for r in views.colour_table(spark).where("i in (0, 255)").orderBy("i").collect()] == [(0, 120, 69, 25), (255, 16, 105, 34)]
