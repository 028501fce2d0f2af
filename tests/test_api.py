"""The store under the names of its interface: requests in, records, scenes, series, artefacts and provenance out."""

from datetime import date, datetime

import pytest

from verdara.api import Store
from verdara.operators.process import UserInput


def test_a_request_goes_in_and_is_read_back(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.list_analyses().count() == 0 and s.get_analysis("x").count() == 0 and s.timeseries("x").count() == 0 and s.public_config()["max_scenes"] == 12
    s.add("regions", spark.createDataFrame([("r2", "Zebra plain", "b", [10.0, 0.0, 10.1, 0.1]), ("r1", "Alder wood", "a", [-83.30, 42.55, -83.15, 42.65])], "id string, name string, label string, bbox array<double>"))
    assert [r["id"] for r in s.regions().collect()] == ["r1", "r2"]
    fields = "id string, region_id string, bbox array<double>, start_date date, end_date date, scene_limit int"
    start, end = date(2023, 1, 1), date(2023, 12, 31)
    good = [("a1", "r1", None, start, end, None), ("a2", None, [10.0, 0.0, 10.05, 0.05], start, end, 3)]
    bad = [("b1", "r9", None, start, end, None), ("b2", "r1", [10.0, 0.0, 10.1, 0.1], end, start, 99), ("b3", None, None, start, end, None)]
    with pytest.raises(UserInput, match="b1: unknown_region; b2: region_and_bbox, end_before_start, scene_limit; b3: no_area"):
        s.submit(spark.createDataFrame(good + bad, fields), date(2024, 6, 1))
    assert s.list_analyses().count() == 0  # all or nothing
    s.submit(spark.createDataFrame(good, fields), date(2024, 6, 1))
    page = s.list_analyses(limit=1, offset=1).collect()
    assert len(page) == 1 and page[0]["total"] == 2 and page[0]["status"] == "queued"
    one = s.get_analysis("a1").first()
    assert one["region"]["name"] == "Alder wood" and one["area_km2"] == 136.75 and one["links"]["timeseries"] == "/api/v1/analyses/a1/timeseries" and one["scene_limit"] == 6
    at = [datetime(2023, 5, d) for d in (3, 1, 2)]
    s.add("scenes", spark.createDataFrame([("s1", "a1", "i1", "k1", at[0], 5.0, ["i1", "i9"]), ("s2", "a1", "i2", "k2", at[1], 7.0, []), ("s3", "a2", "i3", "k3", at[2], 1.0, None)], "id string, analysis_id string, item_id string, acquisition_key string, observed_at timestamp, cloud_cover_pct double, contributing_item_ids array<string>"))
    s.add("observations", spark.createDataFrame([("o1", "a1", "s1", 0.5, True), ("o2", "a1", "s2", 0.4, True), ("o3", "a1", "s2", 0.1, False), ("o4", "a2", "s3", 0.9, True)], "id string, analysis_id string, scene_id string, ndvi_mean double, usable boolean"))
    s.add("artifacts", spark.createDataFrame([("f2", "a1", None, "provenance", at[0]), ("f1", "a1", "s2", "ndvi_cog", at[1]), ("f3", "a2", "s3", "ndvi_cog", at[2])], "id string, analysis_id string, scene_id string, artifact_type string, created_at timestamp"))
    s.add("provenance", spark.createDataFrame([("a1", '{"analysis_id": "a1"}')], "analysis_id string, document string"))
    assert [(r["id"], r["contributing_item_ids"]) for r in s.scenes("a1").collect()] == [("s2", ["i2"]), ("s1", ["i1", "i9"])]
    assert [(r["acquisition_key"], r["ndvi_mean"]) for r in s.timeseries("a1").collect()] == [("k2", 0.4), ("k1", 0.5)]
    assert [(r["id"], r["item_id"]) for r in s.artifacts("a1").collect()] == [("f1", "i2"), ("f2", None)]
    assert "$.analysis_id: format" in s.provenance("a1").first()["breaches"] and s.provenance("a9").count() == 0
    with pytest.raises(ValueError):
        s.list_analyses(limit=0)
