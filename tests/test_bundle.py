"""Bundles: out of one store, into another, twice, and with bytes that were changed."""

import hashlib

import pytest
from pyspark.sql import functions as F

from verdara.sinks import bundle


def test_out_and_in(spark, tmp_path):
    files = tmp_path / "files.d"
    contents = {f"a{k}/f{k}.bin": bytes([k]) * (k * 1000) for k in range(4)}
    for name, content in contents.items():
        (files / name).parent.mkdir(parents=True, exist_ok=True)
        (files / name).write_bytes(content)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    tables = {
        "analyses": spark.createDataFrame([(k, "succeeded") for k in range(4)], "id int, status string"),
        "scenes": spark.createDataFrame([(10 + k, k) for k in range(4)], "id int, analysis_id int"),
        "observations": spark.createDataFrame([(20 + k, k, 0.5) for k in range(4)], "id int, analysis_id int, ndvi double"),
        "artifacts": spark.createDataFrame([(30 + k, k, "ndvi_cog" if k < 3 else "log", n, len(c), sha(c)) for k, (n, c) in enumerate(contents.items())], "id int, analysis_id int, artifact_type string, path string, size_bytes long, sha256 string"),
    }
    out = str(tmp_path / "bundle")
    bundle.export(tables, spark.createDataFrame([(1,), (3,), (3,), (99,)], "id int"), str(files), out, ["ndvi_cog"])
    none = {n: t.where("false") for n, t in tables.items()}
    new, blobs = bundle.take_in(spark, out, none)
    assert {n: sorted(r["id"] for r in t.collect()) for n, t in new.items()} == {"analyses": [1, 3], "scenes": [11, 13], "observations": [21, 23], "artifacts": [31]}
    assert [(r["path"], bytes(r["content"])) for r in blobs.collect()] == [("a1/f1.bin", contents["a1/f1.bin"])]
    again, more = bundle.take_in(spark, out, {n: t.unionByName(new[n]) for n, t in none.items()})
    assert all(t.count() == 0 for t in again.values()) and more.count() == 0
    held = spark.read.parquet(f"{out}/blobs").withColumn("content", F.lit(b"other")).collect()
    spark.createDataFrame(held, spark.read.parquet(f"{out}/blobs").schema).write.mode("overwrite").parquet(f"{out}/blobs")
    with pytest.raises(bundle.BrokenBundle, match="a1/f1.bin"):
        bundle.take_in(spark, out, none)
    with pytest.raises(bundle.BrokenBundle, match="no file for gone"):
        bundle.export({**tables, "artifacts": tables["artifacts"].withColumn("path", F.lit("gone"))}, spark.createDataFrame([(1,)], "id int"), str(files), str(tmp_path / "bad"))
    empty = str(tmp_path / "empty")
    bundle.export(tables, spark.createDataFrame([], "id int"), str(files), empty)
    assert all(t.count() == 0 for t in bundle.take_in(spark, empty, none)[0].values())
