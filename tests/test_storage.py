"""The catalogue's data source (snapshot and server) and the tile table: results, and what isn't read."""

import json
import threading
from datetime import UTC, date, datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from verdara.plans import storage_queries
from verdara.session import scratch_path
from verdara.sources import catalog_source, tiles

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def snapshot(spark):
    path = scratch_path(spark, "catalog")
    items = storage_queries.catalog_items(spark, f"{DATA}/sf0.01")
    catalog_source.write_snapshot(items, path, days=5, rows_per_file=200)
    return path, items


def read_index(spark, path):
    return spark.read.parquet(f"{path}/index")


def test_filters_skip_windows_and_files(spark, snapshot):
    path, items = snapshot
    index = read_index(spark, path)
    files, windows = index.count(), index.select("window_start").distinct().count()
    assert files > 30 and windows >= 6
    reader = catalog_source.CatalogReader({"path": path})
    assert len(reader.partitions()) == windows and sum(len(w.files) for w in reader.partitions()) == files
    table = catalog_source.scan(spark, path=path)
    assert table.rdd.getNumPartitions() == windows and table.count() == items.count()
    low, high = datetime(2024, 1, 8), datetime(2024, 1, 13)
    some = table.where((F.col("ts") >= low) & (F.col("ts") < high))
    assert some.rdd.getNumPartitions() in (1, 2) and some.count() == items.where((F.col("ts") >= low) & (F.col("ts") < high)).count()
    # The same pushed by hand: files of other places aren't opened.
    reader.pushed.terms = [("west", catalog_source.LessThanOrEqual, -130.0), ("east", catalog_source.GreaterThanOrEqual, -140.0), ("collection", catalog_source.EqualTo, "view")]
    assert 0 < sum(len(w.files) for w in reader.partitions()) < files / 4
    near = (F.col("collection") == "view") & catalog_source.in_box(-140.0, -90.0, -130.0, 90.0)
    assert sorted(r[0] for r in table.where(near).select("item_id").collect()) == sorted(r[0] for r in items.where(near).select("item_id").collect())
    # Nothing can be in it: no file is opened, and one empty partition is left.
    none = table.where("cloud > 1000")
    assert none.rdd.getNumPartitions() == 1 and none.count() == 0


def test_scan_agrees_whatever_is_asked(spark, snapshot):
    path, items = snapshot
    table = catalog_source.scan(spark, path=path)
    for condition in ("cloud <= 10 or cloud is null", "collection in ('click', 'error') and cloud >= 95", "not collection = 'view'", "cloud = 7 and west > 0", "ts = timestamp'2024-01-01 00:00:07.179575'", "item_id like 'E00001%'", "collection is null", "cloud > null"):
        assert table.where(condition).count() == items.where(condition).count(), condition
    bounded = catalog_source.scan(spark, path=path, start="2024-01-03", end="2024-01-04")
    assert bounded.count() == items.where("to_date(ts) between '2024-01-03' and '2024-01-04'").count() > 0
    empty = scratch_path(spark, "catalog")
    catalog_source.write_snapshot(items.where("false"), empty)
    assert catalog_source.scan(spark, path=empty).count() == 0
    odd = scratch_path(spark, "catalog")
    catalog_source.write_snapshot(items.limit(3).withColumn("cloud", F.lit(None).cast("double")).withColumn("west", F.lit(None).cast("double")), odd)
    assert catalog_source.scan(spark, path=odd).count() == 3 and catalog_source.scan(spark, path=odd).where("cloud < 50").count() == 0


class Server(BaseHTTPRequestHandler):
    bodies: list = []
    fails = 2

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if Server.fails:
            Server.fails -= 1
            self.send_error(503)
            return
        Server.bodies.append(body)
        first, last = (datetime.fromisoformat(v.replace("Z", "+00:00")) for v in body["datetime"].split("/"))
        at, step = body.get("token", 0), body["limit"]
        days = [first + timedelta(k) for k in range((last - first).days + 1)]
        found = [{"id": f"i{d:%m%d}", "collection": "s2", "bbox": [0, 0, 1, 1], "properties": {"datetime": d.isoformat(), "eo:cloud_cover": d.day}} for d in days if d.day < body.get("query", {}).get("eo:cloud_cover", {}).get("lt", 99)]
        links = [{"rel": "next", "method": "POST", "href": f"http://127.0.0.1:{self.server.server_port}/search", "body": {"token": at + step}}] if at + step < len(found) else []
        answer = json.dumps({"features": found[at : at + step], "links": links}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(answer)

    def log_message(self, *_):
        pass


def test_server_gets_the_filters_and_is_asked_again(spark, monkeypatch):
    monkeypatch.setattr(catalog_source, "PAUSE", 0.01)
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    where = f"http://127.0.0.1:{server.server_port}"
    table = catalog_source.scan(spark, endpoint=where, start="2024-01-01", end="2024-01-31", days=10, page=4)
    got = table.where((F.col("cloud") < 25) & (F.col("collection") == "s2") & catalog_source.in_box(-1.0, -1.0, 2.0, 2.0)).select("item_id", "window_start").collect()
    assert sorted(r[0] for r in got) == [f"i01{k:02d}" for k in range(1, 25)]
    assert len({r[1] for r in got}) == 3 and Server.fails == 0
    assert all(b["collections"] == ["s2"] and b["query"] == {"eo:cloud_cover": {"lt": 25.0}} and b["bbox"] == [-1.0, -1.0, 2.0, 2.0] for b in Server.bodies)
    late = catalog_source.CatalogReader({"endpoint": where, "start": "2024-01-01", "end": "2024-01-31", "days": "10"})
    late.pushed.terms = [("ts", catalog_source.GreaterThanOrEqual, datetime(2024, 1, 15))]
    assert [(w.start, w.end) for w in late.partitions()] == [(date(2024, 1, 15), date(2024, 1, 23)), (date(2024, 1, 24), date(2024, 1, 31))]
    capped = catalog_source.scan(spark, endpoint=where, start="2024-01-01", end="2024-01-08", cap=5, page=4).orderBy("ts").collect()
    assert [r["item_id"] for r in capped] == [f"i010{k}" for k in range(1, 6)] and capped[-1]["truncated"] and capped[0]["ts"].replace(tzinfo=UTC).day == 1
    Server.fails = 99
    with pytest.raises(Exception, match="503"):
        catalog_source.scan(spark, endpoint=where, start="2024-01-01", end="2024-01-02").count()
    server.shutdown()


def scanned(frame):
    """Rows that the scan gave to the plan, once the query ran."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = plan.finalPhysicalPlan().collectLeaves() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan.collectLeaves()
    return leaves.head().metrics().apply("numOutputRows").value()


def test_a_window_reads_few_row_groups(spark):
    path, side = scratch_path(spark, "tiles"), 400
    pixels = spark.range(side * side).selectExpr("'a' item_id", "'red' band", f"cast(id div {side} as int) row", f"cast(id % {side} as int) col", "cast(id as double) value")
    tiles.write(pixels, path, size=4, tiles_per_group=64, partitions=2)
    table = tiles.read(spark, path)
    assert table.count() == 100 * 100
    part = tiles.window(table, (120, 160), (200, 240), size=4)  # 1 % of the raster
    assert sorted((r["row"], r["col"], r["value"]) for r in part.collect()) == [(r, c, float(r * side + c)) for r in range(120, 160) for c in range(200, 240)]
    assert scanned(part) < 0.05 * 100 * 100
    assert "PushedFilters: [" in part._jdf.queryExecution().toString() and "tile_row" in part._jdf.queryExecution().toString().split("PushedFilters: [")[1].split("]")[0]


def test_tiles_of_hard_pixels(spark):
    rows = [("a", "r", 0, 0, 1.0), ("a", "r", 0, 0, 2.0), ("a", "r", 5, 6, float("nan")), ("a", "r", 5, 7, None), ("a", "n", -1, 0, 4.0), (None, None, 70_000, 3, 5.0), ("a", "r", 1, None, 6.0)]
    frame = spark.createDataFrame(rows, "item_id string, band string, row int, col int, value double")
    path = scratch_path(spark, "tiles")
    tiles.write(frame, path, size=4)
    table = tiles.read(spark, path)
    whole = tiles.window(table, (0, 262_144), (0, 262_144), size=4)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted([("a", "r", 0, 0, 2.0), (None, None, 70_000, 3, 5.0)], key=str)
    assert tiles.window(table, (8, 9), (8, 9), size=4).count() == 0
    empty = scratch_path(spark, "tiles")
    tiles.write(frame.where("false"), empty)
    assert tiles.window(tiles.read(spark, empty), (0, 9), (0, 9)).count() == 0
