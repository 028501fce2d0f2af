"""Streams with timers: expiry, poison, restarts from a checkpoint, and state that goes."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import Observation

from conftest import DATA
from verdara.plans import scale_queries
from verdara.streaming import metrics, state

START = datetime(2024, 1, 1)


def minute(k):
    return START + timedelta(minutes=k)


def state_rows(query):
    """Rows of state that the last batch left."""
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]][-1]


def fed(spark, root, schema, batches, make, start):
    """Run a stream over batches, one query each, so that every batch but the first begins from the checkpoint."""
    last = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        last = start(make(spark.readStream.schema(schema).parquet(f"{root}/in")), f"{root}/checkpoint")
        last.awaitTermination(180)
    return last


def test_leases_expire_and_poison_is_routed(spark, tmp_path):
    schema = "message_id string, analysis_id string, at timestamp, event string"
    batches = [
        [("a", "x", minute(0), "sent"), ("b", "y", minute(0), "sent"), ("c", "", minute(1), "sent"), ("d", "z", minute(2), "sent"), ("a", "x", minute(5), "done")],
        [("tick", "t", minute(60), "sent"), ("tick", "t", minute(61), "done"), ("d", "z", minute(50), "done")],
        [("tick2", "t", minute(200), "sent"), ("tick2", "t", minute(201), "done")],
        [("tick3", "t", minute(400), "sent"), ("tick3", "t", minute(401), "done")],
        [("tick4", "t", minute(500), "sent"), ("tick4", "t", minute(501), "done")],
    ]
    good, poison = str(tmp_path / "good"), str(tmp_path / "poison")
    last = fed(spark, str(tmp_path), schema, batches, lambda s: state.deliveries(s, lease_s=1800), lambda s, c: state.route(s, good, poison, c))
    got = {}
    for r in spark.read.parquet(good).collect():
        got.setdefault(r["message_id"], []).append((r["delivery"], (r["at"] - START).total_seconds() / 60))
    assert sorted(got["a"]) == [(1, 0.0)] and sorted(got["b"]) == [(1, 0.0), (2, 30.0), (3, 60.0)]
    assert sorted(got["d"])[:2] == [(1, 2.0), (2, 32.0)] and len(got["d"]) <= 3
    bad = sorted((r["message_id"], r["delivery"]) for r in spark.read.parquet(poison).collect())
    assert ("c", 1) in bad and ("b", 4) in bad
    assert state_rows(last) <= 1  # the timer of none but the last batch's message may be left


def test_claims_go_stale_by_timer(spark, tmp_path):
    schema = "analysis_id string, at timestamp, event string"
    batches = [
        [("x", minute(0), "claim"), ("x", minute(60), "claim"), ("y", minute(0), "claim")],
        [("x", minute(180), "claim"), ("y", minute(61), "done"), ("y", minute(170), "claim")],
        [("z", minute(2000), "claim"), ("z", minute(2000), "done")],
        [("y", minute(2001), "claim"), ("w", minute(60 * 24 * 40), "other")],
        [("w", minute(60 * 24 * 80), "other")],
    ]
    out = str(tmp_path / "out")
    start = lambda s, c: s.writeStream.format("parquet").option("path", out).option("checkpointLocation", c).outputMode("append").trigger(availableNow=True).start()
    last = fed(spark, str(tmp_path), schema, batches, state.claims, start)
    got = sorted((r["analysis_id"], (r["at"] - START).total_seconds() / 60, r["granted"]) for r in spark.read.parquet(out).collect())
    assert got == [("x", 0, True), ("x", 60, False), ("x", 180, True), ("y", 0, True), ("y", 170, False), ("y", 2001, False), ("z", 2000, True)]
    assert state_rows(last) == 0


def test_limits_are_forgotten(spark, tmp_path):
    schema = "client string, ts timestamp"
    batches = [[("a", minute(1)), ("a", minute(0)), ("a", minute(30)), ("b", minute(5))], [("a", minute(61)), ("a", minute(61))], [("c", minute(1000))], [("c", minute(3000))], [("c", minute(5000))]]
    out = str(tmp_path / "out")
    start = lambda s, c: s.writeStream.format("parquet").option("path", out).option("checkpointLocation", c).outputMode("append").trigger(availableNow=True).start()
    last = fed(spark, str(tmp_path), schema, batches, lambda s: state.rate_limited(s, 2), start)
    got = sorted((r["client"], (r["ts"] - START).total_seconds() / 60, r["accepted"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", 0, True), ("a", 1, True), ("a", 30, False), ("a", 61, False), ("a", 61, True), ("b", 5, True), ("c", 1000, True), ("c", 3000, True), ("c", 5000, True)]
    assert state_rows(last) <= 2  # c's own, and its timer


def test_late_granules_correct_what_was_published(spark, tmp_path):
    rng = random.Random(1)
    schema = "acquisition_key string, item_id string, ts timestamp, cloud double"
    granules = [(f"k{k % 7}", f"i{k:03d}", minute(k), None if k % 11 == 0 else float(k % 50)) for k in range(120)]
    for turn in range(2):
        order = granules + rng.sample(granules, 20)  # some come twice
        rng.shuffle(order)
        root = tmp_path / str(turn)
        last = fed(spark, str(root), schema, [order[i::4] for i in range(4)], state.corrected, lambda s, c, root=root: state.publish(s, str(root / "out"), c))
        got = {r["acquisition_key"]: (r["granule_count"], r["observed_at"], r["item_ids"], r["least_cloud"]) for r in state.series(spark.read.parquet(str(root / "out"))).collect()}
        want = {}
        for k in {g[0] for g in granules}:
            own = sorted(g for g in granules if g[0] == k)
            want[k] = (len(own), min(g[2] for g in own), [g[1] for g in own], min(g[3] for g in own if g[3] is not None))
        assert got == want and spark.read.parquet(str(root / "out")).agg({"version": "max"}).first()[0] > 1
        assert state_rows(last) > 0


def test_observed_metrics_equal_those_of_the_table(spark, tmp_path):
    runs = scale_queries.runs(spark, f"{DATA}/sf0.01").cache()
    want = {r["name"]: r.asDict() for r in metrics.histograms(runs).collect()}
    once = Observation("one run")
    metrics.observe(runs, once).write.format("noop").mode("overwrite").save()
    collector = metrics.Collector()
    spark.streams.addListener(collector)
    try:
        runs.repartition(5).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        metrics.observe(stream).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
        for _ in range(100):
            if collector.seen.get("job_duration:count") == runs.count():
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(collector)
    assert collector.batches >= 5
    for seen in (once.get, collector.seen):
        for row in metrics.report(seen):
            other = want[row["name"]]
            assert (row["count"], row["least"], row["most"], row["counts"]) == (other["count"], other["least"], other["most"], other["counts"])
            assert row["sum"] == other["sum"] or abs(row["sum"] - other["sum"]) < 1e-6 * abs(other["sum"])
    none = metrics.report(metrics.merge([{"queue_delay:count": 0, "queue_delay:sum": 0.0, "queue_delay:min": None}]))
    assert none[0]["count"] == 0 and none[0]["least"] is None and sum(none[0]["counts"]) == 0
