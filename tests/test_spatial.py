"""The spatial join against all pairs, with boxes of all sizes, hot places and rims."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from verdara.operators import grid, grid_cells, spatial


def boxes(rng, n, hot):
    out = []
    for k in range(n):
        w, s, size = rng.uniform(-185, 180), rng.uniform(-92, 90), 10 ** rng.uniform(-5, 2)
        if rng.random() < hot:
            w, s = 7.5, 45.0
        out.append((k, w, s, w + size * rng.random(), s + size * rng.random()))
    # Points, shared sides, the whole globe, and rows that have no box.
    return out + [(n, 7.5, 45.0, 7.5, 45.0), (n + 1, -180.0, -90.0, 180.0, 90.0), (n + 2, 0.0, 0.0, 45.0, 45.0), (n + 3, 45.0, 45.0, 90.0, 90.0), (n + 4, 9.0, 0.0, 8.0, 1.0), (n + 5, None, 0.0, 1.0, 1.0)]


SCHEMA = "id int, west double, south double, east double, north double"


def box():
    return {n: F.col(n) for n in spatial.BOX}


@pytest.mark.parametrize("limit", [50_000, 7])
def test_meets_as_all_pairs_do(spark, limit):
    rng = random.Random(1)
    a, b = boxes(rng, 300, 0.3), boxes(rng, 200, 0.2)
    meets = lambda p, q: p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]
    sound = lambda p: p[1] is not None and p[1] <= p[3] and p[2] <= p[4]
    want = sorted((p[0], q[0]) for p in a for q in b if sound(p) and sound(q) and meets(p, q))
    joined = spatial.meeting(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), box(), box(), limit)
    got = sorted((r["l"]["id"], r["r"]["id"]) for r in joined.collect())
    assert got == want and len(want) > 2000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_boxes_are_worked_out_once(spark):
    """However often the join looks at them: filters that are pushed below a costly box repeat it."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def east(west):
        calls.add(1)
        return west + 1.0

    rows = spark.range(40).select("id", F.col("id").cast("double").alias("west"))
    costly = rows.select("id", F.col("west"), F.lit(0.0).alias("south"), east("west").alias("east"), F.lit(1.0).alias("north"))
    assert spatial.meeting(costly, costly.where("false"), box(), box()).count() == 0 and calls.value == 40


def test_grids_are_made_by_many_tasks(spark):
    one = spark.createDataFrame([(1, [{"x": 10.0, "y": 50.0}, {"x": 10.1, "y": 50.0}, {"x": 10.0, "y": 50.1}])] * 64, "id int, ring array<struct<x:double,y:double>>").coalesce(1)
    own = grid.canonical_grids(one).groupBy(F.spark_partition_id()).count().count()
    assert own > 4


def test_cells_of_many_grids_in_one_call(spark, monkeypatch):
    """Batches of grids as one at a time: rings of any length, none, grids without cells, NaN-free bands across grids."""
    one = lambda **kw: dict(dict(id=0, ring=None, epsg=1, left=0.0, top=40.0, width=3, height=2, resolution=10.0), **kw)
    ring = lambda *points: [{"x": float(x), "y": float(y)} for x, y in points]
    square, star = ring((5, 35), (25, 35), (25, 21), (5, 21)), ring((0, 40), (30, 33), (0, 26), (30, 20), (15, 40))
    rows = [one(id=k, ring=r) for k, r in enumerate((square, None, star, []))] + [one(id=4, ring=square, width=0), one(id=5, ring=square, left=None), one(id=6, ring=star, width=300, height=90)]
    table = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", pa.int64()), ("ring", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("epsg", pa.int32()), *[(k, pa.float64()) for k in ("left", "top")], *[(k, pa.int32()) for k in ("width", "height")], ("resolution", pa.float64())]))
    want = []
    for r in (Row(**r) for r in rows):
        inside = lambda x, y: sum((p["y"] > y) != (q["y"] > y) and (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"] > x for p, q in zip(r.ring, r.ring[1:] + r.ring[:1], strict=True)) % 2 == 1 if r.ring else False  # noqa: E731, B023
        if r.left is not None:
            cells = [(i, j, r.left + (j + 0.5) * 10, r.top - (i + 0.5) * 10) for i in range(r.height) for j in range(r.width)]
            want += [(r.id, i, j, x, y, inside(x, y)) for i, j, x, y in cells]
    for band in (65_536, 7):
        monkeypatch.setattr(grid_cells, "BAND", band)
        batches = list(grid_cells.GridCellBatches().eval(table))
        assert [tuple(c.values()) for b in batches for c in b.to_pylist()] == want
        assert sum(b.num_rows for b in batches[:1]) > 12 or band == 7  # several grids in one batch
        assert [c for r in rows for c in grid_cells.GridCells().eval(Row(**r))] == want


def test_empty_sides(spark):
    one = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], SCHEMA)
    for left, right in ((one, one.where("false")), (one.where("false"), one), (one.where("false"), one.where("false"))):
        assert spatial.meeting(left, right, box(), box()).count() == 0


def test_cells_by_the_table_function(spark, monkeypatch):
    """As `grid.cells` makes them, from SQL too; in bands, and for grids without cells."""
    monkeypatch.setattr(grid_cells, "BAND", 7)
    shape = [(0.0, 0.0), (0.002, 0.0005), (0.0015, 0.002), (0.0008, 0.0009)]
    table = [(k, [{"x": 10 + k + a, "y": 50.0 + b} for a, b in shape]) for k in range(3)]
    grids = grid.canonical_grids(spark.createDataFrame(table, "id int, ring array<struct<x:double,y:double>>"))
    names = ("id", "row", "col", "x", "y", "in_aoi")
    got = grid_cells.cells(grids, "id")
    assert got.columns == list(names)
    want = sorted(map(tuple, grid.cells(grids).select(*names).collect()))
    assert sorted(map(tuple, got.collect())) == want and {r[5] for r in want} == {True, False}
    spark.range(1).selectExpr("id", "cast(null as array<struct<x:double,y:double>>) ring", "1 epsg", "0D left", "20D top", "2 width", "id height", "10D resolution").createOrReplaceTempView("bare")
    assert spark.sql("SELECT * FROM grid_cells(TABLE(SELECT * FROM bare) PARTITION BY id)").count() == 0
    assert [tuple(r) for r in spark.sql("SELECT row, col, x, y, in_aoi FROM grid_cells(TABLE(SELECT id, ring, epsg, left, top, width, 1 AS height, resolution FROM bare) PARTITION BY id)").collect()] == [(0, 0, 5.0, 15.0, False), (0, 1, 15.0, 15.0, False)]
